"""Calendar tables: product sessions, named session windows, session state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.market_time import Calendar, at_minute, market_date, plus_minutes

#: Name, start and end as Chicago minutes, minutes of a base bucket.
SESSIONS = [("full", 17 * 60, 16 * 60, 60), ("rth", 8 * 60 + 30, 15 * 60, 30), ("asia", 17 * 60, 2 * 60, 30), ("europe", 2 * 60, 8 * 60 + 30, 30)]


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("trade_date"))


def day_span(rows: DataFrame, instant: str, before: int = 8, after: int = 8) -> DataFrame:
    """All days from some before the first instant to some after the last: one row a day, so a small table."""
    ends = rows.agg(F.min(market_date(instant)).alias("a"), F.max(market_date(instant)).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence(F.date_sub("a", before), F.date_add("b", after))).alias("trade_date"))


def product_sessions(dates: DataFrame, calendar: Calendar) -> DataFrame:
    """(trade_date, open_utc, close_utc, ordinary_close_utc) of the trading days; close_utc honours early closes."""
    d = F.col("trade_date")
    return dates.where(calendar.is_trading_day(d)).select("trade_date", calendar.session_open(d).alias("open_utc"), calendar.session_close(d).alias("close_utc"), calendar.ordinary_close(d).alias("ordinary_close_utc"))


def session_windows(dates: DataFrame, calendar: Calendar, sessions: list[tuple[str, int, int, int]] = SESSIONS) -> DataFrame:
    """(session, trade_date, start_utc, end_utc, base_minutes) of every named session that the calendar has."""
    d = F.col("trade_date")
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("session"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(b).alias("base_minutes")) for n, s, e, b in sessions]))
    rows = dates.where(calendar.is_trading_day(d)).select("trade_date", named.alias("x")).select("trade_date", "x.*")
    edge = lambda c: at_minute(F.when(F.col(c) >= calendar.open, F.date_sub(d, 1)).otherwise(d), F.col(c))
    rows = rows.select("session", "trade_date", edge("s").alias("start_utc"), edge("e").alias("end_utc"), "base_minutes")
    fits = (F.col("end_utc") > F.col("start_utc")) & (calendar.trade_date("start_utc") == d)
    ends = (F.col("end_utc") == calendar.ordinary_close(d)) | F.coalesce(calendar.trade_date("end_utc") == d, F.lit(False))
    return rows.where(fits & ends)


def session_trade_dates(windows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sessions whose whole window lies in [start, end]."""
    return windows.where((F.col("start_utc") >= start) & (F.col("end_utc") <= end)).select("session", "trade_date")


def last_closed(windows: DataFrame, now: Column, n: int) -> DataFrame:
    w = Window.partitionBy("session").orderBy(F.desc("trade_date"))
    return windows.where(F.col("end_utc") <= now).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).select("session", "trade_date", "start_utc", "end_utc")


def session_state(instants: DataFrame, dates: DataFrame, calendar: Calendar, at: str = "at_utc") -> DataFrame:
    """Each instant with its session: open or not, trade date, close, minutes to it, next open, whether its day is a holiday.

    The session is found from the instant itself; the next opening comes from the
    opening of the first later trading day, looked up by Chicago date, so no
    range join is needed.
    """
    days_ = product_sessions(dates, calendar)
    w = Window.orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, 0)
    # for each calendar day the openings of the next two sessions from that day on
    upcoming = dates.join(days_, "trade_date", "left")
    nearest = F.min("open_utc").over(w)
    ahead = upcoming.select(F.col("trade_date").alias("_day"), nearest.alias("_next"))
    rows = instants.withColumn("trade_date", calendar.trade_date(at))
    close = calendar.session_close(F.col("trade_date"))
    rows = rows.withColumn("close_utc", close).withColumn("is_open", F.coalesce(F.col(at) < F.col("close_utc"), F.lit(False)))
    day = market_date(at)
    candidates = rows.withColumn("_d0", day).withColumn("_d1", F.date_add(day, 1)).withColumn("_d2", F.date_add(day, 2))
    for k in range(3):
        side = F.broadcast(ahead.select(F.col("_day").alias(f"_d{k}"), F.col("_next").alias(f"_n{k}")))
        candidates = candidates.join(side, f"_d{k}", "left")
    after = [F.when(F.col(f"_n{k}") > F.col(at), F.col(f"_n{k}")) for k in range(3)]
    holiday = day.cast("string").isin(*calendar.holidays) if calendar.holidays else F.lit(False)
    return candidates.select(
        *instants.columns,
        "is_open",
        F.when(F.col("is_open"), F.col("trade_date")).alias("trade_date"),
        F.when(F.col("is_open"), F.col("close_utc")).alias("close_utc"),
        F.when(F.col("is_open"), F.timestamp_diff("MINUTE", F.col(at), F.col("close_utc"))).alias("minutes_to_close"),
        F.coalesce(*after).alias("next_open_utc"),
        holiday.alias("is_holiday"),
    )


def expected_grid(dates: DataFrame, calendar: Calendar, minutes: int) -> DataFrame:
    """(trade_date, bucket_start): every bucket that the calendar expects."""
    s = product_sessions(dates, calendar)
    from ..functions.market_time import align_up

    first = align_up("open_utc", minutes)
    steps = F.sequence(first, F.col("ordinary_close_utc"), F.make_dt_interval(mins=F.lit(minutes)))
    rows = s.select("trade_date", "ordinary_close_utc", F.explode(steps).alias("bucket_start"))
    return rows.where(plus_minutes("bucket_start", minutes) <= F.col("ordinary_close_utc")).where(calendar.is_expected("bucket_start", minutes)).select("trade_date", "bucket_start")


def _grid_overhangs(dates: DataFrame, calendar: Calendar, sizes: list[int]) -> DataFrame:
    """(minutes, grid_overhangs): does a step of the size from a session's open reach over its close?"""
    s = product_sessions(dates, calendar).select("trade_date", "open_utc", "ordinary_close_utc", F.explode(F.array(*map(F.lit, sizes))).alias("minutes"))
    n = F.timestamp_diff("MINUTE", F.col("open_utc"), F.col("ordinary_close_utc"))
    steps = s.select("minutes", "open_utc", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / F.col("minutes")).cast("int"))).alias("k"))
    at = plus_minutes("open_utc", (F.col("k") * F.col("minutes")).cast("int"))
    return steps.withColumn("at", at).groupBy("minutes").agg(F.bool_or(~calendar.is_expected("at", F.col("minutes"))).alias("grid_overhangs"))


def _bars_overhang(bars: DataFrame, calendar: Calendar) -> DataFrame:
    return bars.groupBy("venue", "instrument", "resolution_minutes").agg(F.bool_or(~calendar.is_expected("bucket_start", F.col("resolution_minutes"))).alias("bars_overhang"))


def series_overhangs(bars: DataFrame, dates: DataFrame, calendar: Calendar, sizes: list[int]) -> DataFrame:
    """(venue, instrument, resolution_minutes, overhangs) of each series: its grid's steps or its own bars; a size that is not among `sizes` goes by its bars."""
    grid = _grid_overhangs(dates, calendar, sizes).withColumnRenamed("minutes", "resolution_minutes")
    own = _bars_overhang(bars, calendar).join(grid, "resolution_minutes", "left")
    return own.select("venue", "instrument", "resolution_minutes", (F.coalesce("grid_overhangs", F.lit(False)) | F.coalesce("bars_overhang", F.lit(False))).alias("overhangs"))


def overhangs(bars: DataFrame, dates: DataFrame, calendar: Calendar, sizes: list[int]) -> DataFrame:
    """For each bar size: does a grid step from a session's open reach over its close, or does the series hold a bar that does?"""
    grid, own = _grid_overhangs(dates, calendar, sizes), _bars_overhang(bars, calendar)
    return grid.join(own, F.col("minutes") == F.col("resolution_minutes"), "left").select(
        F.col("minutes").alias("resolution_minutes"), "instrument", (F.col("grid_overhangs") | F.coalesce("bars_overhang", F.lit(False))).alias("overhangs")
    )
