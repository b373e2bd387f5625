import os

import duckdb
import pytest

from compare import rows_of
from fablespark.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, sf, name):
    ours = q.queries()[name](spark, sf).toPandas()
    assert len(ours)
    if name in q.oracle_sql():
        db = duckdb.connect()
        for file in os.listdir(sf):
            db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
        assert rows_of(ours) == rows_of(db.execute(q.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    return con


def test_pieces_keep_limits_overlap_and_text(spark, sf, db):
    pieces = q.queries()["p2_pieces"](spark, sf).toPandas()  # noqa: F841 - DuckDB reads it
    found = db.execute("""
        WITH t AS (SELECT DISTINCT chunk_id, text AS whole, max_tokens FROM book_chunks JOIN chunk_profiles USING (profile_id)), p AS (SELECT *, lead(start_pos) OVER w AS next_start, lead(tokens) OVER w AS next_tokens FROM pieces WINDOW w AS (PARTITION BY chunk_id ORDER BY piece_index))
        SELECT bool_and(tokens <= max_tokens), bool_and(text = substring(whole, start_pos + 1, end_pos - start_pos)), bool_and(next_start IS NULL OR next_start <= end_pos), count(*) FROM p JOIN t USING (chunk_id)""").fetchone()
    assert found[:3] == (True, True, True) and found[3] == len(pieces)


def test_sentences_hold_every_visible_character_once(spark, sf, db):
    spans = q.queries()["p3_found"](spark, sf).toPandas()
    texts = dict(db.execute("SELECT DISTINCT chunk_id, text FROM book_chunks WHERE length(trim(text)) > 0").fetchall())
    for chunk, own in spans.groupby("chunk_id"):
        text = texts.pop(chunk)
        last = 0
        for a, b in sorted(zip(own["start_pos"], own["end_pos"])):
            assert a >= last and not text[last:a].strip("​﻿").strip() and text[a:b] == text[a:b].strip()
            last = b
        assert not text[last:].strip("​﻿").strip()
    assert all(not t.strip("​﻿").strip() for t in texts.values())


def test_name_pairs_are_ordered_stored_names(spark, sf, db):
    pairs = q.queries()["p4_found"](spark, sf).toPandas()
    stored = set(db.execute("SELECT DISTINCT book_num, entity_type, name FROM entities_raw WHERE entity_type IN ('character', 'group')").fetchall())
    assert not pairs.duplicated().any() and (pairs["name_a"] < pairs["name_b"]).all()
    assert all((r.book_num, r.entity_type, n) in stored for r in pairs.itertuples() for n in (r.name_a, r.name_b))


def test_containers_hold_every_token_within_capacity(spark, sf, db):
    packed = q.queries()["p6_packed"](spark, sf).toPandas()
    capacity = dict(db.execute("SELECT container_id, capacity_tokens FROM container_sizes").fetchall())
    filled = packed.groupby(["container_id", "container_no"])["tokens"].sum().reset_index()
    assert (filled["tokens"] <= filled["container_id"].map(capacity)).all()
    sizes = packed.groupby(["container_id", "doc_id"]).agg(tokens=("tokens", "sum"), pieces=("tokens", "size"), told=("n_pieces", "max")).reset_index()
    assert (sizes["pieces"] == sizes["told"]).all() and (sizes["pieces"] == -(-sizes["tokens"] // sizes["container_id"].map(capacity))).all()
    assert sizes.groupby("doc_id")["tokens"].nunique().eq(1).all() and sizes.groupby("container_id")["tokens"].sum().nunique() == 1


def test_mixes_keep_repeats_and_shares(spark, sf, db):
    mixed = q.queries()["p7_mixed"](spark, sf).toPandas()
    report = q.queries()["p7_shares"](spark, sf).toPandas()
    most = {(m, s): n for m, s, n in db.execute("SELECT mix_name, source, max_repeats FROM mix_targets").fetchall()}
    used = mixed.groupby(["mix_name", "source", "doc_id"]).size()
    assert all(n <= most[m, s] for (m, s, _), n in used.items()) and not mixed.duplicated(["mix_name", "doc_id", "repeat"]).any()
    told = mixed.groupby(["mix_name", "source"])["tokens"].sum()
    for r in report.itertuples():
        own = report[report["mix_name"] == r.mix_name]
        assert r.tokens == told.get((r.mix_name, r.source), 0) and abs(r.actual_share - r.tokens / own["tokens"].sum()) < 1e-6 and r.short_tokens >= 0


def test_redacted_texts_differ_at_the_spans_alone(spark, sf, db):
    spans = q.queries()["p8_found"](spark, sf).toPandas()
    redacted = dict(q.queries()["p8_redacted"](spark, sf).toPandas()[["doc_id", "text"]].itertuples(index=False))
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    by_doc = {d: sorted(zip(o["start_pos"], o["end_pos"], o["kind"])) for d, o in spans.groupby("doc_id")}
    for doc, text in texts.items():
        out, last = "", 0
        for a, b, kind in by_doc.get(doc, []):
            assert a >= last and b > a
            out, last = out + text[last:a] + f"<{kind.upper()}>", b
        assert redacted[doc] == (None if text is None else out + text[last:])
