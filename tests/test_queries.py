import os

import duckdb
import pytest

from compare import rows_of
from fablespark.plans import queries as q


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, sf, db, name):
    ours, theirs = q.queries()[name](spark, sf).toPandas(), db.execute(q.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, sf, name):
    assert q.queries()[name](spark, sf).count() > 0


def test_total_rows_are_sums(spark, sf):
    rows = q.queries()["entity_counts_total"](spark, sf).collect()
    total = next(r for r in rows if r["is_total"] == 1)
    assert total["total"] == sum(r["total"] for r in rows if r["is_total"] == 0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_hybrid_has_hits_of_the_dense_side_only(spark, sf):
    lexical = {(r["query_id"], r["chunk_id"]) for r in q.queries()["bm25_top_k"](spark, sf).collect()}
    fused = {(r["query_id"], r["chunk_id"]) for r in q.queries()["hybrid_top_k"](spark, sf).collect()}
    assert fused - lexical
