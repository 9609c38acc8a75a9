"""Contract candidates, front-month order, tenure, history slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.contracts import MONTH_CODES, expiry_rank, has_product
from ..functions.market_time import Calendar, at_minute
from .series import SERIES, contract_segments


def candidates(dates: DataFrame, cycle: str = "HMUZ", depth: int = 2) -> DataFrame:
    """(trade_date, position, expiry, rank): the next `depth` expiries of a product's month cycle, this month included."""
    d = F.col("trade_date")
    months = F.array(*[F.struct(F.lit(MONTH_CODES.index(m) + 1).alias("month"), F.lit(m).alias("code")) for m in cycle])
    years = F.array(F.year(d), F.year(d) + 1, *[F.year(d) + 1 + k for k in range(1, depth // len(cycle) + 1)])
    rows = dates.select("trade_date", F.explode(years).alias("y")).select("trade_date", "y", F.explode(months).alias("m"))
    rows = rows.withColumn("rank", F.col("y") * 12 + F.col("m.month")).where(F.col("rank") >= F.year(d) * 12 + F.month(d))
    w = Window.partitionBy("trade_date").orderBy("rank")
    rows = rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= depth)
    return rows.select("trade_date", "position", F.concat("m.code", F.lpad((F.col("y") % 100).cast("string"), 2, "0")).alias("expiry"), "rank")


def front_month_order(contracts: DataFrame) -> DataFrame:
    """(instrument, contract_id, active) numbered: active first, then by expiry, ids that cannot be read last, then by id."""
    w = Window.partitionBy("instrument").orderBy(F.desc("active"), F.asc_nulls_last(expiry_rank("contract_id")), "contract_id")
    return contracts.withColumn("position", F.row_number().over(w))


def of_product(contracts: DataFrame, instruments: DataFrame) -> DataFrame:
    """Contracts whose id names their instrument's product."""
    rows = contracts.join(instruments.select(F.col("symbol").alias("instrument"), "product_code"), "instrument")
    return rows.where(has_product("contract_id", "product_code")).select(*contracts.columns)


def tenure_start(bars: DataFrame, front: DataFrame, now: Column) -> DataFrame:
    """The first bucket of the trailing run of the front contract (series keys, front); a week before now if there is none."""
    rows = bars.join(front, ["venue", "instrument"]).groupBy(*SERIES, "front").agg(
        F.max(F.when(~F.col("contract_id").eqNullSafe(F.col("front")), F.col("bucket_start"))).alias("_other"),
    )
    own = bars.join(rows, SERIES).where(F.col("contract_id") == F.col("front")).where(F.col("_other").isNull() | (F.col("bucket_start") > F.col("_other")))
    first = own.groupBy(*SERIES).agg(F.min("bucket_start").alias("_start"))
    return rows.join(first, SERIES, "left").select(*SERIES, "front", F.coalesce("_start", now - F.make_dt_interval(days=F.lit(7))).alias("tenure_start"))


def roll_seam(bars: DataFrame, flips: DataFrame, as_of: Column, days: int = 2) -> DataFrame:
    """Contract runs of the bars within some days of each instrument's flip (venue, instrument, flipped_at)."""
    near = bars.join(flips.select("venue", "instrument", "flipped_at"), ["venue", "instrument"])
    span = F.make_dt_interval(days=F.lit(days))
    near = near.where((F.col("bucket_start") >= F.col("flipped_at") - span) & (F.col("bucket_start") <= F.least(F.col("flipped_at") + span, as_of)))
    return contract_segments(near.drop("flipped_at"))


def candidate_slices(gaps: DataFrame, tenure: DataFrame, calendar: Calendar, listed: DataFrame, cycle: str = "HMUZ", depth: int = 2) -> DataFrame:
    """Which contracts to load for each missing range, cut where the tenure starts and where the nearest expiry changes.

    gaps: venue, instrument, range_start, range_end; tenure: venue, instrument,
    front, tenure_start; listed: instrument, expiry, contract_id. From the
    tenure's start on the front contract is asked; before it the listed
    candidates; `unresolved` names those not listed, and where none is the front
    is asked after all.
    """
    rows = gaps.join(tenure, ["venue", "instrument"])
    early = rows.where(F.col("range_start") < F.col("tenure_start")).select(*rows.columns, F.least("range_end", "tenure_start").alias("_end"))
    days = early.select("venue", "instrument", "front", "range_start", F.col("_end").alias("range_end"), F.explode(F.sequence(F.to_date("range_start"), F.date_add(F.to_date("_end"), 1))).alias("trade_date"))
    # the part of the range that belongs to each trade date
    opened, closed = at_minute(F.date_sub("trade_date", 1), calendar.open), at_minute(F.col("trade_date"), calendar.open)
    days = days.withColumn("s", F.greatest(F.col("range_start"), opened)).withColumn("e", F.least(F.col("range_end"), closed)).where("s < e")
    nearest = candidates(days.select("trade_date").distinct(), cycle, depth).groupBy("trade_date").agg(F.sort_array(F.collect_list(F.struct("rank", "expiry"))).alias("c"))
    days = days.join(nearest, "trade_date").withColumn("nearest", F.col("c")[0]["rank"])
    part = ["venue", "instrument", "front", "range_start", "range_end"]
    cut = days.groupBy(*part, "nearest").agg(F.min("s").alias("slice_start"), F.max("e").alias("slice_end"), F.first("c").alias("c"))
    wanted = cut.withColumn("x", F.explode("c")).select(*cut.columns, "x.expiry").join(listed, ["instrument", "expiry"], "left")
    early = wanted.groupBy("venue", "instrument", "front", "slice_start", "slice_end").agg(
        F.sort_array(F.collect_list("contract_id")).alias("candidates"), F.sort_array(F.collect_list(F.when(F.col("contract_id").isNull(), F.col("expiry")))).alias("unresolved")
    )
    early = early.withColumn("rank", F.when(F.size("candidates") == 0, 2).when(F.size("unresolved") > 0, 1).otherwise(0)).withColumn("candidates", F.when(F.size("candidates") == 0, F.array("front")).otherwise(F.col("candidates")))
    late = rows.where(F.col("range_end") > F.col("tenure_start")).select("venue", "instrument", "front", F.greatest("range_start", "tenure_start").alias("slice_start"), F.col("range_end").alias("slice_end"), F.array("front").alias("candidates"), F.array().cast("array<string>").alias("unresolved"), F.lit(0).alias("rank"))
    return early.unionByName(late).drop("front")


def history_selection(slices: DataFrame) -> DataFrame:
    """The worst rank over the slices of an instrument, and the expiries that no listed contract resolves."""
    return slices.groupBy("venue", "instrument").agg(F.max("rank").alias("rank"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("unresolved")))).alias("unresolved"), F.count("*").alias("slices"))

