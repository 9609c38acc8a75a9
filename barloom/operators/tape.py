"""Trade prints: footprints, volume ladders and profiles, session volume and the volume front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.contracts import expiry_rank
from ..functions.market_time import Calendar, align_down
from ..sources.storage import stored
from .slices import running_sum

VALUE_AREA = 0.70


def counted(prints: DataFrame) -> DataFrame:
    """Prints that a footprint counts: a known direction and a positive size."""
    return prints.where(F.col("direction").isin(1, 2) & (F.col("size") > 0))


def footprint(prints: DataFrame, minutes: int) -> DataFrame:
    """Buy and sell volume by instrument, bucket and price, without the buckets that more than one contract touched.

    One shuffle by (bucket, price) after partial sums; the number of contracts
    is then read from the cells, which are far fewer than the prints.
    """
    cells = (
        counted(prints)
        .withColumn("bucket_start", align_down("trade_time_utc", minutes))
        .groupBy("venue", "instrument", "bucket_start", "price")
        .agg(
            F.sum(F.when(F.col("direction") == 1, F.col("size")).otherwise(0)).alias("buy_volume"),
            F.sum(F.when(F.col("direction") == 2, F.col("size")).otherwise(0)).alias("sell_volume"),
            F.min("contract_id").alias("_low"),
            F.max("contract_id").alias("_high"),
            F.max(F.col("contract_id").isNull()).alias("_unknown"),
        )
    )
    whole = Window.partitionBy("venue", "instrument", "bucket_start")
    low, high = F.min("_low").over(whole), F.max("_high").over(whole)
    unknown = F.max("_unknown").over(whole)
    one = F.when(low.isNull(), True).otherwise((low == high) & ~unknown)
    return cells.withColumn("_one", one).where("_one").select("venue", "instrument", F.lit(minutes).alias("resolution_minutes"), "bucket_start", "price", "buy_volume", "sell_volume")


def volume_ladder(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, "price").agg(F.sum(F.col("buy_volume") + F.col("sell_volume")).alias("volume"))


def point_of_control(ladder: DataFrame, keys: list[str]) -> DataFrame:
    """The price with the most volume; of equals the one nearest the ladder's middle, then the lower."""
    whole = Window.partitionBy(*keys)
    middle = (F.min("price").over(whole) + F.max("price").over(whole)) / 2
    rows = ladder.withColumn("_off", F.abs(F.col("price") - middle))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("volume"), "_off", "price"))
    return rows.withColumn("_rank", rank).where("_rank = 1").select(*keys, "price", "volume")


def value_area(ladder: DataFrame, keys: list[str], share: float = VALUE_AREA) -> DataFrame:
    """Point of control, value area and totals of each ladder.

    From the point of control the area takes the two levels below or the two
    above, whichever hold more, until it has the share of all volume. Equal
    sides go below; a side without levels loses.
    """
    poc = point_of_control(ladder, keys).select(*keys, F.col("price").alias("poc"))
    rows = ladder.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("price", "volume"))).alias("levels"))
    rows = rows.join(poc, keys).withColumn("n", F.size("levels")).withColumn("total", F.aggregate("levels", F.lit(0).cast("long"), lambda acc, x: acc + x["volume"]))
    rows = rows.withColumn("at", F.array_position(F.transform("levels", lambda x: x["price"]), F.col("poc")).cast("int"))
    grown = F.expr(
        f"""aggregate(sequence(1, n), named_struct('lo', at, 'hi', at, 'v', element_at(levels, at).volume), (a, i) -> CASE
              WHEN a.v >= {share} * total OR (a.lo = 1 AND a.hi = n) THEN a
              WHEN a.hi = n OR (a.lo > 1 AND
                   element_at(levels, greatest(a.lo - 1, 1)).volume + if(a.lo > 2, element_at(levels, greatest(a.lo - 2, 1)).volume, 0)
                >= element_at(levels, least(a.hi + 1, n)).volume + if(a.hi + 1 < n, element_at(levels, least(a.hi + 2, n)).volume, 0))
              THEN named_struct('lo', greatest(a.lo - 2, 1), 'hi', a.hi,
                   'v', a.v + element_at(levels, greatest(a.lo - 1, 1)).volume + if(a.lo > 2, element_at(levels, greatest(a.lo - 2, 1)).volume, 0))
              ELSE named_struct('lo', a.lo, 'hi', least(a.hi + 2, n),
                   'v', a.v + element_at(levels, least(a.hi + 1, n)).volume + if(a.hi + 1 < n, element_at(levels, least(a.hi + 2, n)).volume, 0))
            END)"""
    )
    rows = rows.withColumn("area", grown)
    level = lambda i: F.element_at("levels", i)["price"]
    return rows.select(*keys, "poc", level(F.col("area.lo")).alias("val"), level(F.col("area.hi")).alias("vah"), F.col("area.v").alias("area_volume"), F.col("total").alias("total_volume"), F.col("n").cast("long").alias("levels"))


def session_contract_volume(prints: DataFrame, calendar: Calendar) -> DataFrame:
    """Volume by trade date and contract, all directions; prints outside sessions or without size are skipped."""
    rows = prints.where(F.col("size") > 0).withColumn("trade_date", calendar.trade_date("trade_time_utc")).where("trade_date is not null")
    return rows.groupBy("venue", "instrument", "trade_date", "contract_id").agg(F.sum("size").alias("volume"))


def session_winners(volumes: DataFrame) -> DataFrame:
    """The contract with the most volume of each session; NULL when two share it."""
    whole = Window.partitionBy("venue", "instrument", "trade_date")
    top = volumes.withColumn("_top", F.max("volume").over(whole)).where("volume = _top")
    return top.groupBy("venue", "instrument", "trade_date").agg(F.when(F.count("*") == 1, F.min("contract_id")).alias("winner"), F.max("volume").alias("volume"), F.count("*").alias("leaders"))


def volume_front(volumes: DataFrame) -> DataFrame:
    """Per instrument: the winner of the last session, and the latest session whose winner differs from the last known one."""
    w = Window.partitionBy("venue", "instrument").orderBy("trade_date")
    rows = session_winners(volumes).withColumn("before", F.last("winner", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    turned = F.col("winner").isNotNull() & F.col("before").isNotNull() & (F.col("winner") != F.col("before"))
    change = F.when(turned, F.struct("trade_date", "before", "winner"))
    return rows.groupBy("venue", "instrument").agg(F.max("trade_date").alias("last_session"), F.max_by("winner", "trade_date").alias("active"), F.max(change).alias("c")).select(
        "venue", "instrument", "last_session", "active", F.col("c.trade_date").alias("changed_on"), F.col("c.before").alias("from_contract"), F.col("c.winner").alias("to_contract")
    )


def front_flip(prints: DataFrame, front: DataFrame, calendar: Calendar, slice_seconds: int = 600) -> DataFrame:
    """The first instant of the changeover session at which the new contract's running volume exceeds the old one's."""
    f = front.where("changed_on is not null").select("venue", "instrument", F.col("changed_on").alias("trade_date"), "from_contract", "to_contract")
    rows = prints.where(F.col("size") > 0).withColumn("trade_date", calendar.trade_date("trade_time_utc")).join(f, ["venue", "instrument", "trade_date"])
    signed = F.when(F.col("contract_id") == F.col("to_contract"), F.col("size")).when(F.col("contract_id") == F.col("from_contract"), -F.col("size"))
    netted = rows.withColumn("_lead", signed).where("_lead is not null").groupBy("venue", "instrument", "trade_date", "from_contract", "to_contract", "trade_time_utc").agg(F.sum("_lead").alias("_lead"))
    # one row an instant of the sessions that turned, in slices: an instrument's prints do not meet in one task
    netted = stored(netted.withColumn("_piece", F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("trade_time_utc")) / slice_seconds)), "leads")
    ahead = running_sum(netted, ["venue", "instrument"], "_piece", ["trade_time_utc"], "_sum", F.col("_lead"))
    return ahead.groupBy("venue", "instrument", F.col("trade_date").alias("changed_on"), "from_contract", "to_contract").agg(F.min(F.when(F.col("_sum") > 0, F.col("trade_time_utc"))).alias("flipped_at"))


def front_vs_gateway(front: DataFrame, picks: DataFrame) -> DataFrame:
    """The tape's front beside the venue's pick (venue, instrument, picked): which is used, and whether they agree."""
    rows = picks.join(front.select("venue", "instrument", "active"), ["venue", "instrument"], "full")
    used = F.coalesce("picked", "active")
    why = F.when(F.col("active").isNull() & F.col("picked").isNull(), "none").when(F.col("active").isNull(), "no tape front").when(F.col("picked").isNull(), "no gateway pick").when(F.col("active") == F.col("picked"), "agree").otherwise("differ")
    return rows.select("venue", "instrument", "active", "picked", used.alias("used"), F.coalesce(F.col("active") == F.col("picked"), F.lit(False)).alias("agree"), why.alias("why"))


def historical_contract(by_contract: DataFrame, calendar: Calendar, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(choices, winner bars): one contract for each trade date.

    The stored contract (venue, instrument, trade_date, stored) stays while it is
    still offered; else the one with the most volume, of equals the nearest
    expiry, ids that cannot be read last, then by id. Bars outside sessions
    count to their UTC date.
    """
    dated = by_contract.withColumn("trade_date", F.coalesce(calendar.trade_date("bucket_start"), F.to_date("bucket_start")))
    keys = ["venue", "instrument", "resolution_minutes", "trade_date"]
    volumes = dated.groupBy(*keys, "contract_id").agg(F.sum("volume").alias("volume"))
    if stored is None:
        volumes = volumes.withColumn("stored", F.lit(None).cast("string"))
    else:
        volumes = volumes.join(stored, ["venue", "instrument", "trade_date"], "left")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce(F.col("contract_id") == F.col("stored"), F.lit(False))), F.desc("volume"), F.asc_nulls_last(expiry_rank("contract_id")), "contract_id")
    choices = volumes.withColumn("_rank", F.row_number().over(order)).withColumn("offered", F.count("*").over(Window.partitionBy(*keys))).where("_rank = 1").select(*keys, "contract_id", "volume", "offered")
    return choices, dated.join(choices.select(*keys, "contract_id"), [*keys, "contract_id"], "left_semi")


def tie_days(by_contract: DataFrame, calendar: Calendar) -> DataFrame:
    dated = by_contract.withColumn("trade_date", F.coalesce(calendar.trade_date("bucket_start"), F.to_date("bucket_start")))
    volumes = dated.groupBy("venue", "instrument", "trade_date", "contract_id").agg(F.sum("volume").alias("volume"))
    return session_winners(volumes).where("leaders > 1").select("venue", "instrument", "trade_date", "leaders", "volume")


def last_tick(prints: DataFrame, start: Column, end: Column) -> DataFrame:
    inside = prints.where((F.col("trade_time_utc") >= start) & (F.col("trade_time_utc") < end))
    return inside.groupBy("venue", "instrument", "contract_id").agg(F.max("trade_time_utc").alias("last_tick"), F.count("*").alias("prints"))
