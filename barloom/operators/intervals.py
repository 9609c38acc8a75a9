"""Half-open intervals: union, complement, overlap, containment; missing buckets of a bar series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.market_time import plus_minutes
from ..sources.storage import stored
from .slices import running_max, running_sum


def _reached(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that are not empty, with `_reach`, the latest end of those before them, and the day of their start; a stored table."""
    known = rows.where(F.col(start) < F.col(end)).withColumn("_piece", F.to_date(start))
    return stored(running_max(known, keys, "_piece", [start, end], "_reach", F.col(end), before=True), "reaches")


def union(rows: DataFrame, keys: list[str], start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Overlapping and touching intervals of each key as one; empty ones are left out.

    A key's intervals meet in one task by the day of their start only; what the
    days before reach, and where the island that goes on began, is carried.
    """
    reached = _reached(rows, keys, start, end)
    opened = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    # starts ascend, so the island of a row is the latest start that opened one
    islands = running_max(reached, keys, "_piece", [start, end], "_island", opened)
    return islands.groupBy(*keys, F.col("_island").alias(start)).agg(F.max(end).alias(end))


def complement(rows: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """What of each window (keys, window_start, window_end) no interval covers.

    `rows` has the window's columns too: the intervals that touch it. A gap lies
    between what is reached and the next start, by days as in `union`, and after
    the last end.
    """
    w_keys = [*keys, "window_start", "window_end"]
    clipped = rows.select(*w_keys, F.greatest("range_start", "window_start").alias("range_start"), F.least("range_end", "window_end").alias("range_end"))
    reached = _reached(clipped, w_keys, "range_start", "range_end")
    inside = reached.select(*w_keys, F.coalesce("_reach", "window_start").alias("gap_start"), F.col("range_start").alias("gap_end"))
    ends = reached.groupBy(*w_keys).agg(F.max("range_end").alias("_last"))
    after = windows.join(ends, w_keys, "left").select(*w_keys, F.coalesce("_last", "window_start").alias("gap_start"), F.col("window_end").alias("gap_end"))
    return inside.unionByName(after).where("gap_start < gap_end")


def by_day(rows: DataFrame, start: str, end: str, last: Column) -> DataFrame:
    """One row for each UTC day that an interval touches, up to `last`: an equality key for overlap joins."""
    stop = F.least(F.col(end), last)
    return rows.where(F.col(start) < stop).withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date(stop))))


def overlapping(rows: DataFrame, windows: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """Intervals joined with the windows of their keys that they overlap, each pair once."""
    left = by_day(rows, "range_start", "range_end", last)
    right = by_day(windows, "window_start", "window_end", last)
    pairs = left.join(right, [*keys, "_day"]).where("range_start < window_end and range_end > window_start")
    # a pair meets on every day they share; the first of these is the later of their first days
    return pairs.where(F.col("_day") == F.greatest(F.to_date("range_start"), F.to_date("window_start"))).drop("_day")


def bar_gaps(bars: DataFrame, grid: DataFrame, minutes: int) -> DataFrame:
    """Missing ranges of each series: (venue, instrument, range_start, range_end, buckets).

    Candidates are the grid's buckets and stored buckets of unknown contract;
    those stored with a contract are held. A run of missing candidates ends only
    at a held one, so closed hours inside it do not cut it. Held buckets are
    counted by days of a series, with what the days before hold carried.
    """
    keys = ["venue", "instrument"]
    series = bars.select(*keys).distinct()
    unknown = bars.where(F.col("contract_id").isNull()).select(*keys, "bucket_start")
    # each series meets the grid under its days: an equality key, however many series there are
    dated = grid.select("bucket_start", F.to_date("bucket_start").alias("_day"))
    span = dated.agg(F.min("_day").alias("_a"), F.max("_day").alias("_b"))  # one row
    days = series.crossJoin(F.broadcast(span)).where("_a is not null").select(*keys, F.explode(F.sequence("_a", "_b")).alias("_day"))
    candidates = days.join(dated, "_day").select(*keys, "bucket_start").unionByName(unknown).distinct()
    held = bars.where(F.col("contract_id").isNotNull()).select(*keys, "bucket_start", F.lit(1).alias("held"))
    rows = stored(candidates.join(held, [*keys, "bucket_start"], "left").withColumn("_day", F.to_date("bucket_start")), "candidates")
    rows = running_sum(rows, keys, "_day", ["bucket_start"], "_island", F.col("held"))
    missing = rows.where("held is null").groupBy(*keys, "_island")
    return missing.agg(F.min("bucket_start").alias("range_start"), plus_minutes(F.max("bucket_start"), minutes).alias("range_end"), F.count("*").alias("buckets")).drop("_island")


def covered_window(ranges: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per instrument: the newest run of tape of the front contract inside [start, end).

    Front: the contract with the latest clipped end, then latest start, then the
    smaller id. `narrowed` tells that something of the window was lost; an
    instrument without tape in the window has no row.
    """
    keys = ["venue", "instrument"]
    clipped = ranges.select(*keys, "contract_id", F.greatest(F.col("range_start"), start).alias("range_start"), F.least(F.col("range_end"), end).alias("range_end")).where("range_start < range_end")
    front = clipped.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("range_end"), F.desc("range_start"), "contract_id"))).where("_rank = 1").select(*keys, "contract_id")
    runs = union(clipped.join(front, [*keys, "contract_id"], "left_semi"), [*keys, "contract_id"])
    newest = runs.groupBy(*keys, "contract_id").agg(F.max(F.struct("range_start", "range_end")).alias("x"))
    return newest.select(*keys, "contract_id", "x.range_start", "x.range_end", ((F.col("x.range_start") > start) | (F.col("x.range_end") < end)).alias("narrowed"))


def answered(slices: DataFrame, empties: DataFrame, now: Column) -> DataFrame:
    """Slices (slice_id, venue, instrument, slice_start, slice_end, candidates) with `answered`.

    A slice is answered when for every candidate contract one merged interval of
    unexpired empty coverage contains it; without candidates it is not.
    """
    live = union(empties.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)), ["venue", "instrument", "contract_id"])
    wanted = slices.select("*", F.explode_outer("candidates").alias("contract_id"))
    hit = wanted.join(live, ["venue", "instrument", "contract_id"], "left").withColumn("_in", (F.col("range_start") <= F.col("slice_start")) & (F.col("range_end") >= F.col("slice_end")))
    counted = hit.groupBy("slice_id").agg(F.count_distinct(F.when(F.col("_in"), F.col("contract_id"))).alias("_n"))
    return slices.join(counted, "slice_id").withColumn("answered", (F.size("candidates") > 0) & (F.col("_n") == F.size(F.array_distinct("candidates")))).drop("_n")
