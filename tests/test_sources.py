import json
import zipfile

import pytest

from fablespark.sources import files
from fablespark.sources.epub import read_epub
from fablespark.sources.files import copy, list_files, read_json, read_lines, read_whole, remove, write_json, write_lines
from fablespark.streaming import ingest


def test_json_and_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    write_json(df, str(tmp_path / "j"))
    assert sorted(map(tuple, read_json(spark, str(tmp_path / "j"), "a INT, b STRING", lines=True).collect())) == [(1, "é"), (2, None)]
    (tmp_path / "whole.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=2))
    assert read_json(spark, str(tmp_path / "whole.json"), "a INT").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    bad = read_json(spark, str(tmp_path / "bad.jsonl"), "a INT", lines=True, corrupt="broken").cache()
    assert bad.where("broken IS NOT NULL").count() == 1
    write_lines(df.select("b").na.fill("x"), "b", str(tmp_path / "t"))
    assert read_lines(spark, str(tmp_path / "t")).count() == 2
    assert read_whole(spark, str(tmp_path / "whole.json")).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    assert list_files(spark, str(tmp_path), "*.txt").count() == 1
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path), "*.none")
    assert copy(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")) and not copy(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
    assert remove(spark, str(tmp_path / "b.txt")) and not (tmp_path / "b.txt").exists()


def test_epub(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.epub", "w") as z:
        z.writestr("OEBPS/content.opf", '<package xmlns="http://x"><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("OEBPS/a.xhtml", "<p>A</p>")
        z.writestr("OEBPS/b.xhtml", "<p>B</p>")
    pages = read_epub(spark, str(tmp_path)).orderBy("position").collect()
    assert [(p["position"], p["html"]) for p in pages] == [(0, "<p>B</p>"), (1, "<p>A</p>")]


def test_ingest_is_resumed(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest_new(spark, source, "a INT", target, checkpoint, lambda b: b.selectExpr("a * 2 AS b")).awaitTermination()
    (tmp_path / "in/1.json").write_text('{"a": 1}\n')
    run()
    (tmp_path / "in/2.json").write_text('{"a": 2}\n')
    run()
    run()
    assert sorted(r["b"] for r in spark.read.parquet(target).collect()) == [2, 4]


def test_remembered_entities(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"book_num": 1, "chapter_num": 1, "entity_type": "c", "name": "A"}\n{"book_num": 1, "chapter_num": 2, "entity_type": "c", "name": "B"}\n')
    stream = spark.readStream.schema("book_num INT, chapter_num INT, entity_type STRING, name STRING").json(str(tmp_path / "in"))
    q = ingest.remember_entities(stream).writeStream.format("memory").queryName("known").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["known"], r["added"]) for r in spark.table("known").collect()] == [(2, 2)]


def test_active_entity(spark):
    turns = spark.createDataFrame([(1, 1, "A"), (1, 2, None), (1, 3, "B"), (2, 1, None)], "conv_id int, turn int, entity string")
    assert [r["active"] for r in ingest.active_entity(turns).orderBy("conv_id", "turn").collect()] == ["A", "A", "B", None]


def test_documents_sizes_and_patterns(spark, tmp_path):
    df = spark.createDataFrame([(2, "ä", [1]), (1, None, None)], "b int, a string, c array<int>")
    files.write_document(df.orderBy("b"), str(tmp_path / "doc"))
    text = files.read_whole(spark, str(tmp_path / "doc")).collect()[0][0]
    assert json.loads(text) == [{"a": None, "b": 1, "c": None}, {"a": "ä", "b": 2, "c": [1]}] and '\n    "a": "ä"' in text
    files.write_tables({"t": df}, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables" / "t.parquet")).count() == 2
    (tmp_path / "src").mkdir()
    for name in ("a.txt", "b.txt", "c.md"):
        (tmp_path / "src" / name).write_text("xyz")
    assert files.size(spark, str(tmp_path / "src")) == 9
    assert files.copy_files(spark, str(tmp_path / "src"), str(tmp_path / "dst"), "*.txt", "b*") == 1 and sorted(p.name for p in (tmp_path / "dst").glob("*.txt")) == ["a.txt"]
