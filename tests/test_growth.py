"""Steps whose cost per task must not grow with the rows of a contract, a bucket or a partition."""

import pytest

from barloom.functions.market_time import position
from barloom.plans.queries import QUERIES
from barloom.sources import samples
from barloom.streaming import tape as live

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quote_events_come_from_one_read_of_the_events(spark):
    assert "Join" not in plan(samples.quote_events(spark, FOLDER))


def test_latest_quotes_neither_sort_nor_shuffle_events(spark, monkeypatch):
    steps = []
    store = getattr(live, "written", None)
    monkeypatch.setattr(live, "written", lambda rows, name: steps.append(plan(rows)) or store(rows, name), raising=False)
    found = live.latest_quotes(samples.quote_events(spark, FOLDER))
    for step in [*steps, plan(found)]:
        assert "SortAggregate" not in step and "SortMergeJoin" not in step


@pytest.mark.parametrize("at", ["0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2024-01-01 00:00:00.000001", "9999-12-31 23:59:59.999999"])
def test_positions_keep_the_order_of_instant_and_sequence(spark, at):
    rows = spark.sql(f"""select at, s from values (null), (timestamp_ntz'{at}'), (timestamp_ntz'2024-01-01') t(at)
        cross join (values (cast(null as bigint)), (-9223372036854775808), (-1L), (0L), (9223372036854775807) u(s))""")
    found = rows.selectExpr("struct(at, s) as pair", "at", "s").withColumn("n", position(rows["at"], rows["s"])).distinct()
    assert [r["pair"] for r in found.orderBy("pair").collect()] == [r["pair"] for r in found.orderBy("n").collect()]
    assert found.where("n is null").isEmpty() and found.select("n").distinct().count() == found.count()


def test_bars_are_aggregated_without_sorting_prints(spark):
    assert "SortAggregate" not in plan(samples.bars(spark, FOLDER)) + plan(samples.bars_by_contract(spark, FOLDER))


@pytest.mark.parametrize("name", ["session_bars", "session_indicator_asof", "reselect_bars"])
def test_bars_are_stored_before_the_calendar_meets_them(spark, name):
    assert "user_id" not in plan(QUERIES[name](spark, FOLDER))  # bars need it, dates do not
