"""Bar series: contract runs, guards, windows of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import stored

SERIES = ["venue", "instrument", "resolution_minutes"]
RUN = [*SERIES, "run_id"]


def over_series(order: str = "bucket_start"):
    return Window.partitionBy(*SERIES).orderBy(order)


def over_run(order: str = "bucket_start"):
    return Window.partitionBy(*RUN).orderBy(order)


def with_runs(bars: DataFrame) -> DataFrame:
    """run_id counts the changes of contract along each series; unknown contracts next to each other are one run."""
    w = over_series()
    before = F.lag("contract_id").over(w)
    first = F.row_number().over(w) == 1
    changed = F.when(first, 0).when(before.eqNullSafe(F.col("contract_id")), 0).otherwise(1)
    return bars.withColumn("_changed", changed).withColumn("run_id", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


#: Rows of a full block: a block is a span of time that a series without gaps fills with so many bars.
BLOCK_ROWS = 4096
BLOCK = [*SERIES, "block"]


def with_columns(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the columns of `more`, which has one row a key; null keys are equal."""
    more = more.withColumnsRenamed({c: f"_key_{c}" for c in keys})
    return rows.join(more, [rows[c].eqNullSafe(more[f"_key_{c}"]) for c in keys]).drop(*[f"_key_{c}" for c in keys])


def runs_in_blocks(bars: DataFrame, block_rows: int = BLOCK_ROWS, carried: tuple[str, ...] = ()) -> DataFrame:
    """`with_runs` by blocks of time: adds block, run_id and `before`, the `carried` columns of the bar before in the run (NULL on a run's first).

    Nothing of a series meets in one task but one row a block: its last bar and
    its number of changes, which windows over blocks hand on. The bars themselves
    are only windowed inside their block. The result is a stored table.
    """
    minutes = F.timestamp_diff("MINUTE", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("bucket_start"))
    rows = bars.withColumn("block", F.floor(minutes / (F.col("resolution_minutes") * block_rows)))
    kept = F.struct("contract_id", *carried)
    blocks, inside = Window.partitionBy(*SERIES).orderBy("block"), Window.partitionBy(*BLOCK).orderBy("bucket_start")
    last = rows.groupBy(*BLOCK).agg(F.max_by(kept, "bucket_start").alias("_last"))
    earlier = last.select(*BLOCK, F.lag("_last").over(blocks).alias("_earlier"))
    rows = rows.withColumn("_inside", F.lag(kept).over(inside)).transform(with_columns, earlier, BLOCK).withColumn("before", F.coalesce("_inside", "_earlier")).drop("_inside", "_earlier")
    changed = F.when(F.col("before").isNull() | F.col("before.contract_id").eqNullSafe(F.col("contract_id")), 0).otherwise(1)
    rows = stored(rows.withColumn("_changed", changed), "runs")
    counts = rows.groupBy(*BLOCK).agg(F.sum("_changed").alias("_n"))
    counts = counts.select(*BLOCK, F.coalesce(F.sum("_n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    within = F.sum("_changed").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run_id", within).transform(with_columns, counts, BLOCK).withColumn("run_id", F.col("run_id") + F.col("_n")).drop("_n").withColumn("before", F.when(F.col("_changed") == 0, F.col("before"))).drop("_changed")


def contract_segments(bars: DataFrame, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """First and last bar and number of bars of each run; runs are found by blocks, or with None in one window a series."""
    runs = runs_in_blocks(bars, block_rows) if block_rows else with_runs(bars)
    return runs.groupBy(*RUN, "contract_id").agg(F.min("bucket_start").alias("first_bucket"), F.max("bucket_start").alias("last_bucket"), F.count("*").alias("bars"))


def newest_segment(bars: DataFrame) -> DataFrame:
    runs = with_runs(bars)
    return runs.withColumn("_last", F.max("run_id").over(Window.partitionBy(*SERIES))).where("run_id = _last").drop("_last")


def latest(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy(F.desc("bucket_start"))
    return bars.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def series_guard(bars: DataFrame, order: str = "arrival") -> DataFrame:
    """Rows that are not strictly after the one before them in arrival order, and rows where the contract changes."""
    w = over_series(order)
    rows = bars.withColumn("_at", F.lag("bucket_start").over(w)).withColumn("_contract", F.lag("contract_id").over(w)).withColumn("_n", F.row_number().over(w))
    late = (F.col("_n") > 1) & (F.col("bucket_start") <= F.col("_at"))
    changed = (F.col("_n") > 1) & ~F.col("contract_id").eqNullSafe(F.col("_contract"))
    found = F.filter(F.array(F.when(late, "not_ascending"), F.when(changed, "contract_change")), lambda x: x.isNotNull())
    return rows.select(*SERIES, order, "bucket_start", F.explode(found).alias("violation"))


def contract_coverage(bars: DataFrame) -> DataFrame:
    """Runs of each series and whether they are one contract, span a roll, or are unknown."""
    runs = contract_segments(bars)
    return runs.groupBy(*SERIES).agg(
        F.count("*").alias("runs"),
        F.count_distinct("contract_id").alias("contracts"),
        F.when(F.count_distinct("contract_id") >= 2, "SpansRoll").when(F.count_if(F.col("contract_id").isNull()) > 0, "Unknown").when(F.count("*") == 1, "SingleContract").otherwise("Unknown").alias("span"),
    )


def available_range(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SERIES).agg(F.min("bucket_start").alias("first_bucket"), F.max("bucket_start").alias("last_bucket"), F.count("*").alias("bars"))


def rows_before(n: int, order: str = "bucket_start"):
    """The frame of a row and the n - 1 rows before it in its run."""
    return over_run(order).rowsBetween(-(n - 1), 0)


def when_warm(value: Column, n: int) -> Column:
    return F.when(F.row_number().over(over_run()) >= n, value)
