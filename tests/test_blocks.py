"""Recurrences by blocks of a series against the scan of whole series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, recurrence
from barloom.operators.recurrence import Derive, Smooth
from barloom.operators.series import RUN, with_runs
from barloom.sources.storage import stored


def bars_of(spark, seed, n=2500):
    r = random.Random(seed)
    rows = []
    for instrument in ("a", "b", None):
        price, contract = 100.0, 1
        at = 0
        for k in range(n if instrument == "a" else n // 5):
            at += 1 if r.random() < 0.97 else r.randrange(2, 400)  # gaps longer than a block
            contract += r.random() < 0.002
            price += r.choice([0.0, 0.0, 0.0]) if 300 < k < 420 else r.gauss(0, 1)  # a stretch without any movement
            low, high = (0.0, 0.0) if 300 < k < 420 else (r.random(), r.random())
            rows.append(("v", instrument, 5, at, None if contract % 7 == 0 else f"c{contract}", price, price + high, price - low, price + r.choice([0.0, 0.1]) * high, float(r.randrange(5))))
    df = spark.createDataFrame(rows, "venue string, instrument string, resolution_minutes int, at long, contract_id string, open double, high double, low double, close double, volume double")
    return df.withColumn("bucket_start", F.timestamp_seconds(F.lit(1_700_000_100) + F.col("at") * 300).cast("timestamp_ntz")).drop("at").repartition(3)


def table(df, columns):
    return {(r["venue"], r["instrument"], r["bucket_start"]): [r["run_id"], *[r[c] for c in columns]] for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        for x, y in zip(got[k], w, strict=True):
            assert (x is None or x != x) == (y is None or y != y), (k, got[k], w)
            assert x is None or x != x or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (k, got[k], w)


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_indicators_by_blocks(spark, block_rows):
    bars = bars_of(spark, block_rows)
    families = [("ema", 20), ("macd", 26), ("atr", 14), ("rsi", 14), ("di", 14), ("ema", 100)]
    columns = ["ema_20", "macd_26", "macd_signal_26", "macd_histogram_26", "atr_14", "rsi_14", "plus_di_14", "minus_di_14", "adx_14", "ema_100"]
    whole, blocks = indicators.wide(bars, families), indicators.wide(bars, families, block_rows=block_rows)
    assert sorted(whole.columns) == sorted(blocks.columns)
    same(table(blocks, columns), table(whole, columns))


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3])
def test_holes_resets_and_seeds_across_blocks(spark, share):
    """Missing values anywhere: before a seed is full, inside it, after it, at the ends of blocks."""
    rows = with_runs(bars_of(spark, 5, 1500)).withColumn("x", F.when(F.rand(3) >= share, F.col("close")))
    rows = rows.withColumn("block", F.floor(F.unix_timestamp(F.col("bucket_start").cast("timestamp")) / 300 / 11))
    rows = stored(rows, "holes")
    steps = [Smooth("a", "x", 5, 0.4), Smooth("b", "x", 40, 0.1), Smooth("r", "x", 6, 0.3, reset=True), Derive("d", ("a", "r"), lambda a, r: a - r), Smooth("e", "d", 9, 0.2, reset=True), Smooth("f", "e", 3, 0.5)]
    got = recurrence.scan_blocks(rows, RUN, "block", "bucket_start", steps)
    want = recurrence.scan(rows.repartition(*RUN), RUN, "bucket_start", steps)
    same(table(got, "abrdef"), table(want, "abrdef"))


def test_a_single_long_run_keeps_several_tasks_busy(spark):
    n = 200_000
    bars = spark.range(n).select(
        F.lit("v").alias("venue"), F.lit("i").alias("instrument"), F.lit(1).alias("resolution_minutes"), F.lit("c").alias("contract_id"),
        F.timestamp_seconds(F.lit(1_600_000_020) + F.col("id") * 60).cast("timestamp_ntz").alias("bucket_start"),
        (100 + F.sin(F.col("id") / 50) + F.rand(1)).alias("close"),
    ).withColumns({"open": F.col("close"), "high": F.col("close") + F.rand(2), "low": F.col("close") - F.rand(4), "volume": F.lit(1.0)})
    bars.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/long-run")
    bars = spark.read.parquet(path)
    found = indicators.wide(bars, [("di", 14)], block_rows=4096)
    assert found.withColumn("task", F.spark_partition_id()).groupBy("task").count().count() > 1
    whole = indicators.wide(bars, [("di", 14)]).select("bucket_start", F.col("adx_14").alias("want"))
    off = found.join(whole, "bucket_start").select(F.max(F.abs(F.col("adx_14") - F.col("want"))).alias("off"), F.count("*").alias("n"), F.count_if(F.col("adx_14").isNull() != F.col("want").isNull()).alias("odd")).first()
    assert off["n"] == n and off["odd"] == 0 and off["off"] < 1e-6
