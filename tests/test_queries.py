"""Every market-data query against its SQL, and the plans' shapes."""

import datetime
import math

import pytest

from barloom.plans.oracles import ORACLES
from barloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["fills_window"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", ["footprint", "session_bars", "bar_gaps", "indicator_catalogue", "coverage_overlap", "retention_plan", "indicator_asof"])
def test_no_nested_loops_over_large_inputs(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_stream_and_batch_agree(spark):
    stream = {tuple(r) for r in QUERIES["stream_coverage"](spark, FOLDER).collect()}
    batch = {tuple(r) for r in QUERIES["batch_coverage"](spark, FOLDER).collect()}
    assert stream == {r for r in batch if r[2].year < 9999}
    one = {tuple(r) for r in QUERIES["latest_quote"](spark, FOLDER).collect()}
    assert one == {tuple(r) for r in QUERIES["latest_quote_stream"](spark, FOLDER).collect()}
    assert one == {tuple(r) for r in QUERIES["latest_quote_upsert"](spark, FOLDER).collect()}
