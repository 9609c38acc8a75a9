"""Running values, islands and frames in slices against windows over whole series and plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from test_blocks import bars_of, table

from barloom.functions.market_time import SAMPLE_CALENDAR
from barloom.operators import asof, frames, indicators, intervals, levels, series, slices

START = datetime(2024, 3, 1)


def window_keys(df):
    """What the windows of a plan are partitioned by, but for those over one row a piece (they sum totals)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if " Window [" in line and "_total" not in line and "_t#" not in line]


@pytest.mark.parametrize("seed", range(3))
def test_running_values_are_those_of_whole_windows(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), k // 7, k, r.choice([None, r.randrange(-5, 9)])) for k in range(200) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "key string, piece long, at long, x long").repartition(3)
    w = Window.partitionBy("key").orderBy("at")
    want = df.select("key", "at", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"), F.max("x").over(w).alias("m"), F.max("x").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"))
    got = slices.running_sum(df, ["key"], "piece", ["at"], "s", F.col("x"))
    got = slices.running_max(got, ["key"], "piece", ["at"], "m", F.col("x"))
    got = slices.running_max(got, ["key"], "piece", ["at"], "b", F.col("x"), before=True)
    rows_of = lambda d: sorted(map(repr, d.select("key", "at", "s", "m", "b").collect()))
    assert rows_of(got) == rows_of(want)
    assert slices.running_sum(df.limit(0), ["key"], "piece", ["at"], "s", F.col("x")).count() == 0


def ranges_of(seed, n=120):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        start = START + timedelta(minutes=30 * r.randrange(48 * 12))
        length = r.choice([-30, 0, 30, 30, 60, 90, 60 * 24 * 3])  # empty ones, and some over days
        out.append((r.choice("ab"), start, start + timedelta(minutes=length)))
    return out + out[:5]


def plain_union(ranges):
    out = []
    for s, e in sorted((s, e) for s, e in ranges if s < e):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_islands_and_gaps_over_days(spark, seed):
    ranges = ranges_of(seed, 25 if seed else 120)
    df = spark.createDataFrame(ranges, "k string, range_start timestamp_ntz, range_end timestamp_ntz").repartition(3)
    want = {k: plain_union([(s, e) for x, s, e in ranges if x == k]) for k in "abc"}
    got = sorted((r["k"], r["range_start"], r["range_end"]) for r in intervals.union(df, ["k"]).collect())
    assert got == sorted((k, s, e) for k, v in want.items() for s, e in v)
    asked = [(k, START + timedelta(hours=a), START + timedelta(hours=b)) for k in "abc" for a, b in ((0, 400), (30, 31), (100, 222))]
    windows = spark.createDataFrame(asked, "k string, window_start timestamp_ntz, window_end timestamp_ntz")
    touching = intervals.overlapping(df, windows, ["k"], F.lit("2024-06-01").cast("timestamp_ntz"))
    gaps = sorted((r["k"], r["window_start"], r["gap_start"], r["gap_end"]) for r in intervals.complement(touching, windows, ["k"]).collect())
    plain = []
    for k, a, b in asked:
        at = a
        for s, e in want[k]:
            if s < b and e > a:
                plain += [(k, a, at, s)] if at < s else []
                at = max(at, e)
        plain += [(k, a, at, b)] if at < b else []
    assert gaps == sorted(plain)


def test_windows_hold_a_piece_only(spark):
    df = spark.createDataFrame(ranges_of(1), "k string, range_start timestamp_ntz, range_end timestamp_ntz")
    keys = window_keys(intervals.union(df, ["k"]))
    assert keys and all("_piece" in line.split("], [")[-2] for line in keys), keys


@pytest.mark.parametrize("seed", range(2))
def test_an_as_of_read_is_a_merge_in_time(spark, seed):
    r = random.Random(seed)
    key = lambda: ("v", r.choice(["a", "b"]), 60, "sma", r.choice([5, 20]))
    at = lambda days: START + timedelta(minutes=r.randrange(0, 60 * 24 * days, 20))
    values = list({(k := key(), t := at(20)): (*k, t, r.random()) for _ in range(60)}.values())
    asks = [(n, *key(), at(400) if n % 3 else at(20)) for n in range(120)] + [(120, *key(), None)]
    v = spark.createDataFrame(values, "venue string, instrument string, resolution_minutes int, indicator string, period int, bucket_start timestamp_ntz, value double").repartition(3)
    a = spark.createDataFrame(asks, "ask_id int, venue string, instrument string, resolution_minutes int, indicator string, period int, as_of_utc timestamp_ntz").repartition(3)
    bars = v.where("value < 0.9").select("venue", "instrument", "resolution_minutes", "bucket_start", F.lit("c").alias("contract_id")).distinct()
    barred = {(x[1], x[5]) for x in values if x[6] < 0.9}
    want = set()
    for n, *k, t in asks:
        before = [(x[5], x[6]) for x in values if list(x[:5]) == k and t is not None and x[5] <= t and (x[1], x[5]) in barred]
        want |= {(n, *max(before))} if before else set()
    got = asof.values_asof(a, v, bars)
    assert {(x["ask_id"], x["bucket_start"], x["value"]) for x in got.collect()} == want and got.count() == len(want) > 50


@pytest.mark.parametrize("block_rows", [7, 100, 4096])
def test_frames_by_chunks(spark, block_rows):
    bars = bars_of(spark, block_rows, 1500)
    families = [("sma", 1), ("sma", 20), ("bb", 20), ("bb", 33), ("vwap_rolling", 20), ("vwap_rolling", 5), ("ema", 10), ("vwap", 1)]
    columns = ["sma_1", "sma_20", "bb_middle_20", "bb_upper_20", "bb_lower_20", "bb_upper_33", "vwap_rolling_20", "vwap_rolling_5", "ema_10", "vwap_1"]
    whole, chunks = indicators.wide(bars, families, SAMPLE_CALENDAR), indicators.wide(bars, families, SAMPLE_CALENDAR, block_rows=block_rows)
    assert sorted(whole.columns) == sorted(chunks.columns)
    got, want = table(chunks, columns), table(whole, columns)
    assert got.keys() == want.keys()
    for k, values in want.items():
        assert got[k][0] == values[0]
        for x, y in zip(got[k][1:], values[1:], strict=True):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-6)), (k, got[k], values)


@pytest.mark.parametrize(("left", "right", "source"), [(5, 3, "HighLow"), (1, 1, "Body"), (40, 60, "HighLow"), (6, 4, "HeikinAshiBody")])
def test_pivots_by_chunks(spark, left, right, source):
    bars = bars_of(spark, left, 1500)
    options = levels.Options(left=left, right=right, source=source)
    values = lambda df: sorted(repr((*[r[c] for c in (*series.RUN, "bucket_start", "kind")], round(r["price"], 6), round(r["prominence"], 6) + 0.0)) for r in df.collect())
    want = values(levels.swing_pivots(bars, options))
    assert want and values(levels.swing_pivots(bars, options, 50)) == want


def test_a_high_price_level_keeps_its_digits(spark):
    n, period = 6000, 5000
    bars = spark.range(n).select(
        F.lit("v").alias("venue"), F.lit("i").alias("instrument"), F.lit(1).alias("resolution_minutes"), F.lit("c").alias("contract_id"),
        F.timestamp_seconds(F.lit(1_600_000_020) + F.col("id") * 60).cast("timestamp_ntz").alias("bucket_start"),
        (F.lit(1e9) + (F.col("id") % 7)).alias("close"),
    ).withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0)})
    rows = indicators.wide(bars, [("bb", period)], block_rows=1000).where(f"bb_upper_{period} is not null").orderBy("bucket_start").collect()
    assert len(rows) == n - period + 1
    for k, r in enumerate(rows):
        values = [(k + i) % 7 for i in range(period)]
        mean = math.fsum(values) / period
        deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in values) / period)
        assert math.isclose(r[f"bb_middle_{period}"] - 1e9, mean, abs_tol=1e-6)
        assert math.isclose((r[f"bb_upper_{period}"] - r[f"bb_middle_{period}"]) / 2, deviation, abs_tol=1e-6)


def test_a_long_run_is_framed_in_many_tasks_without_frames_of_a_period(spark):
    bars = bars_of(spark, 3, 300)
    plan = frames.framed(series.runs_in_blocks(bars, 50, ("close", "high", "low")), [("sma", 20), ("vwap_rolling", 20)], 50)._jdf.queryExecution().executedPlan().toString()
    assert "-19, currentrow" not in plan and "UnboundedFollowing" not in plan
