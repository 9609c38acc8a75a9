"""Session bars: one bar for each named session and trade date, or the reason why there is none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market_time import Calendar, align_up, plus_minutes


def session_grid(windows: DataFrame, calendar: Calendar) -> DataFrame:
    """(session, trade_date, start_utc, end_utc, base_minutes, bucket_start): the base buckets that each window expects."""
    parts = []
    for minutes in (30, 60):
        w = windows.where(F.col("base_minutes") == minutes)
        steps = F.explode(F.sequence(align_up("start_utc", minutes), F.col("end_utc"), F.make_dt_interval(mins=F.lit(minutes))))
        parts.append(w.select("*", steps.alias("bucket_start")).where(plus_minutes("bucket_start", minutes) <= F.col("end_utc")).where(calendar.is_expected("bucket_start", minutes)))
    return parts[0].unionByName(parts[1])


def session_bars(bars: DataFrame, windows: DataFrame, calendar: Calendar, now: Column) -> DataFrame:
    """Present only if every expected bucket is there and all are of one known contract.

    The reasons, in this order: NotClosed, Incomplete, SpansRoll, ProvenanceUnknown.
    """
    series = bars.select("venue", "instrument").distinct()
    grid = session_grid(windows, calendar).crossJoin(F.broadcast(series))
    b = bars.select("venue", "instrument", F.col("resolution_minutes").alias("base_minutes"), "bucket_start", "open", "high", "low", "close", "volume", "contract_id", F.lit(True).alias("there"))
    rows = grid.join(b, ["venue", "instrument", "base_minutes", "bucket_start"], "left")
    got = rows.groupBy("venue", "instrument", "session", "trade_date", "start_utc", "end_utc", "base_minutes").agg(
        F.count("*").alias("expected"),
        F.count("there").alias("held"),
        F.min_by("open", "bucket_start").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bucket_start").alias("close"),
        F.sum("volume").alias("volume"),
        (F.min(F.coalesce("contract_id", F.when(F.col("there"), F.lit("?")))) != F.max(F.coalesce("contract_id", F.when(F.col("there"), F.lit("?"))))).alias("mixed"),
        F.max("contract_id").alias("contract_id"),
    )
    reason = (
        F.when(F.col("end_utc") > now, "NotClosed")
        .when(F.col("held") < F.col("expected"), "Incomplete")
        .when(F.col("mixed"), "SpansRoll")
        .when(F.col("contract_id").isNull(), "ProvenanceUnknown")
    )
    got = got.withColumn("absence", reason).withColumn("missing", F.when(F.col("absence") == "Incomplete", F.col("expected") - F.col("held")))
    keep = lambda c: F.when(F.col("absence").isNull(), F.col(c)).alias(c)
    return got.select("venue", "instrument", "session", "trade_date", "start_utc", "end_utc", "base_minutes", "expected", *map(keep, ("open", "high", "low", "close", "volume", "contract_id")), "absence", "missing")
