"""Reading stored indicator values: semi-joins with bars, as-of and latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .slices import running_max

KEYS = ["venue", "instrument", "resolution_minutes"]


def indicator_series(values: DataFrame, bars: DataFrame) -> DataFrame:
    """Values whose bucket still has a bar."""
    return values.join(bars.select(*KEYS, "bucket_start"), [*KEYS, "bucket_start"], "left_semi")


def latest_values(values: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """The newest value of each indicator and period at or before as_of that still has a bar, with that bar's contract."""
    rows = values.where(F.col("bucket_start") <= as_of).join(bars.select(*KEYS, "bucket_start", "contract_id"), [*KEYS, "bucket_start"])
    newest = rows.groupBy(*KEYS, "indicator", "period").agg(F.max(F.struct("bucket_start", "value", "contract_id")).alias("x"))
    return newest.select(*KEYS, "indicator", "period", "x.bucket_start", "x.value", "x.contract_id")


def values_asof(asks: DataFrame, values: DataFrame, bars: DataFrame, slice_minutes: int = 60) -> DataFrame:
    """Backward as-of read: each ask (ask_id, venue, instrument, resolution_minutes, indicator, period, as_of_utc) with its newest value.

    Values and asks of a key are merged in time, in slices: an ask takes the
    newest value before it in its slice, else the one carried from the slices
    before, however old it is. What is handled is a row for each value, for each
    ask and for each slice that holds one. A value of the ask's own instant
    counts; an ask without a value, or without an instant, has no row.
    """
    key = [*KEYS, "indicator", "period"]
    held = values.join(bars.select(*KEYS, "bucket_start", "contract_id"), [*KEYS, "bucket_start"])
    own = held.select(*key, F.col("bucket_start").alias("_at"), F.struct("bucket_start", "value", "contract_id").alias("_x"), F.lit(0).alias("_asks"))
    asked = asks.where("as_of_utc is not null").select(*key, F.col("as_of_utc").alias("_at"), F.lit(1).alias("_asks"), F.struct(*asks.columns).alias("_ask"))
    minutes = F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("_at"))
    merged = stored(own.unionByName(asked, allowMissingColumns=True).withColumn("_piece", F.floor(minutes / slice_minutes)), "merged")
    # values begin with their time, so the largest so far is the newest
    found = running_max(merged, key, "_piece", ["_at", "_asks"], "_found", F.col("_x")).where("_asks = 1 and _found is not null")
    return found.select("_ask.*", "_found.bucket_start", "_found.value", "_found.contract_id")


def session_values_asof(values: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """Newest value of each session series whose session had closed by as_of; values are keyed by the session's open."""
    rows = values.join(sessions.select("venue", "instrument", "session", F.col("start_utc").alias("bucket_start"), "end_utc"), ["venue", "instrument", "session", "bucket_start"])
    newest = rows.where(F.col("end_utc") <= as_of).groupBy("venue", "instrument", "session", "indicator", "period").agg(F.max(F.struct("bucket_start", "value", "end_utc")).alias("x"))
    return newest.select("venue", "instrument", "session", "indicator", "period", "x.bucket_start", "x.value", "x.end_utc")
