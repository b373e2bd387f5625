import random

from pyspark.sql import functions as F

from fablespark.functions import formatting, jsonfix
from fablespark.functions import text as tx
from fablespark.functions.html import html_paragraphs, page_parts
from fablespark.functions.similarity import alike, common_subsequence, indel_ratio, ratio
from fablespark.functions.vectors import cosine


def value(spark, expression, **columns):
    names = list(columns)
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'int'}" for k, v in columns.items())).select(*names).select(expression.alias("x")).head()["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_common_subsequence_is_that_of_the_table():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert common_subsequence(a, b) == lcs(a, b)


def test_ratios(spark):
    assert (ratio("bard", "bard the bowman"), ratio("gandalf", "gandolf")) == (42, 86)
    assert ratio("", "") == 100 and ratio(None, "a") is None
    rows = spark.createDataFrame([("bard", "bard the bowman"), (None, "x")], "a string, b string").select(indel_ratio("a", "b").alias("r")).collect()
    assert [r["r"] for r in rows] == [42, None]
    assert alike("The Fox", "the fox") and not alike("abc", "xyz")


def test_metric_format(spark):
    m = lambda name, v: value(spark, formatting.metric(F.lit(name), F.col("v")), v=v)
    assert m("avg_x", 3.0) == "3.000"
    assert m("total_time", 3661.0) == "1h 1m 1s"
    assert m("total_time", 3600.0) == "1h 0m"
    assert m("max_x", 7.9) == "7"
    assert value(spark, formatting.metric(F.lit("x"), F.lit(5), F.col("p")), p=12.34) == "5 (12.3%)"
    assert value(spark, formatting.metric(F.lit("x"), F.lit(None).cast("double")), p=1.0) == "—"


def test_yes_or_no(spark):
    assert [value(spark, formatting.yes_or_no(F.col("a")), a=a) for a in ("Yes.", "same scene", "No", "not sure", "hm")] == [True, True, False, False, None]


def test_json_repair(spark):
    schema = "a STRING, c INT"
    parse = lambda t: value(spark, jsonfix.parse_lenient(F.col("t"), schema), t=t)
    assert tuple(parse('{"a": "x" "c": 1}')) == ("x", 1)
    assert tuple(parse('{"a": "", "c": 1}')) == ("", 1)
    assert tuple(parse('Sure!\n{"a": "http://x", "c": 2} // done')) == ("http://x", 2)
    assert parse("nothing") is None
    assert value(spark, jsonfix.as_list(F.col("t")), t='{"a": 1} {"a": 2}') == '[{"a": 1},{"a": 2}]'


def test_text_functions(spark):
    assert value(spark, tx.strip("t"), t="\t a  ") == "a"
    assert value(spark, tx.collapse_breaks(F.col("t")), t="a\n\n\n\nb   c") == "a\n\nb c"
    assert value(spark, tx.blank_line_parts(F.col("t")), t="a\n\n \n\n b") == ["a", "b"]
    assert value(spark, tx.sentences(F.col("t")), t="Aa. Bb! Cc") == ["Aa.", "Bb!", "Cc"]
    assert value(spark, tx.word_count(F.col("t")), t="  a  b\nc ") == 3
    assert value(spark, tx.word_count(F.col("t")), t=" ") == 0
    assert value(spark, tx.char_slices(F.col("t"), 2), t="abcde") == ["ab", "cd", "e"]
    assert value(spark, tx.char_slices(F.col("t"), 2), t="") == []
    assert value(spark, tx.preview(F.col("t"), 3), t="") == "[Empty chunk]"
    assert value(spark, tx.chunk_id(F.lit(1), F.lit(2), F.lit(3)), t="") == "book_01_ch_02_chunk_003"


def test_mention_predicate(spark):
    said = lambda text, term: value(spark, tx.mentions(F.col("t"), F.col("m")), t=text, m=term)
    assert said("The Ring.", "ring") and not said("string", "ring")
    assert said("cold tooks", "old took")
    assert not said("aère", "ère") and said("l'ère", "ère")
    assert said("a (b) c", "(b)")


def test_cosine(spark):
    assert value(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == 1 / 2**0.5
    assert value(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) is None


def test_html(spark):
    page = "<html><head><style>p{}</style></head><h1> T </h1><p>One <b>two</b><p>Three<script>x</script></p><div>no</div><p> </p></html>"
    assert page_parts(page) == (["One two", "Three"], {"h1": "T"})
    assert page_parts("<p>One <b>two</b></p>", glue=True)[0] == ["Onetwo"]
    assert page_parts(None) == ([], {})
    rows = html_paragraphs(spark.createDataFrame([(1, page), (2, None)], "k int, html string"), "k").orderBy("k").collect()
    assert rows[0]["paragraphs"] == ["One two", "Three"] and rows[1]["paragraphs"] == [] and rows[1]["h1"] is None
