"""The market-data operators as queries over the shared tables. Each returns plain columns: doubles, longs, strings, instants in UTC."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import contracts as fc
from ..functions.market_time import SAMPLE_CALENDAR as CAL
from ..functions.market_time import align_down, align_up, plus_minutes
from ..operators import accounts, asof, calendars, contracts, indicators, intervals, levels, maintenance, notes, recurrence, series, sessions, snapshot, tape
from ..sources import samples, tape_files
from ..sources.samples import ntz, raw
from ..sources.storage import scratch, stored
from ..sources.versions import VersionedTable
from ..streaming import tape as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BAR = ["instrument", "bucket_start", "open", "high", "low", "close", "volume", "contract_id"]
NOW = "2024-01-31 00:00:00"
AS_OF = "2024-01-25 12:00:00"
SMALL = levels.Options(left=5, right=3, source="HighLow", min_significance=0.1, width_percent=400.0)

#: The snapshot looks back so far; the level queries read whole runs.
SNAPSHOT_BARS = 500


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.day_span(samples.trades(spark, sf_dir), "trade_time_utc")


# --- scans, sources, sinks ----------------------------------------------------------------------------------------------


@query
def bars_window(spark, sf_dir):
    b = samples.bars(spark, sf_dir)
    return b.where((F.col("instrument") == "ES") & (F.col("bucket_start") >= ntz("2024-01-08")) & (F.col("bucket_start") < ntz("2024-01-15"))).select(*BAR)


@query
def bars_latest_n(spark, sf_dir):
    return series.latest(samples.bars(spark, sf_dir), 50).select(*BAR)


@query
def trades_window(spark, sf_dir):
    t = samples.trades(spark, sf_dir)
    inside = t.where((F.col("instrument") == "NQ") & (F.col("trade_time_utc") >= ntz("2024-01-10 06:00:00")) & (F.col("trade_time_utc") < ntz("2024-01-12")))
    return inside.select("instrument", "contract_id", "trade_time_utc", "sequence", "price", "size", "direction")


def _exported(spark, sf_dir, kind):
    path = scratch(spark, f"tape-{kind}")
    tape_files.export_trades(samples.trades(spark, sf_dir), path, ntz(NOW), kind)
    return path


def _file_columns(rows):
    return rows.select("instrument", "contract_id", "day", "trade_time_utc", "sequence", F.col("price").cast("double").alias("price"), "size", "direction", "recorded_at")


@query
def tape_export(spark, sf_dir):
    files = tape_files.manifest(spark, _exported(spark, sf_dir, "parquet"))
    return files.groupBy("instrument", "contract_id", F.col("day").cast("date").alias("day")).agg(F.count("*").alias("files"))


@query
def tape_read_csv(spark, sf_dir):
    return _file_columns(tape_files.read_csv(spark, _exported(spark, sf_dir, "csv")))


@query
def tape_read_parquet(spark, sf_dir):
    return _file_columns(tape_files.read_parquet(spark, _exported(spark, sf_dir, "parquet")))


@query
def coverage_export(spark, sf_dir):
    """Closed coverage written as gzipped CSV by day and read back."""
    path = scratch(spark, "tape-coverage")
    held = samples.tape_coverage(spark, sf_dir).withColumn("recorded_at", F.col("range_end"))
    tape_files.export_coverage(held, path, ntz(NOW), ntz(samples.OPEN_END), "csv")
    return tape_files.read_coverage(spark, path, "csv").select("instrument", "contract_id", "day", "range_start", "range_end", "recorded_at")


@query
def footprint_export(spark, sf_dir):
    """Footprint cells written as Parquet by day and read back."""
    path = scratch(spark, "tape-footprint")
    cells = tape.footprint(samples.trades(spark, sf_dir), 60)
    tape_files.export_footprint(cells.withColumn("resolution_minutes", F.lit(60)).withColumn("recorded_at", plus_minutes(F.col("bucket_start"), 60)), path, ntz(NOW))
    rows = tape_files.read_footprint(spark, path)
    return rows.select("instrument", "day", "bucket_start", F.col("price").cast("double").alias("price"), "buy_volume", "sell_volume", "recorded_at")


@query
def export_manifest(spark, sf_dir):
    """One row a file with its hash; the row counts are read from the files."""
    path = _exported(spark, sf_dir, "parquet")
    rows = tape_files.read_parquet(spark, path).groupBy(*tape_files.KEY).agg(F.count("*").alias("row_count"))
    files = tape_files.manifest(spark, path).withColumn("day", F.col("day").cast("date"))
    return files.join(rows, tape_files.KEY).select("instrument", "contract_id", "day", "row_count", (F.length("sha256") == 64).alias("hashed"))


@query
def export_verify(spark, sf_dir):
    """One day's file is left out on purpose, so that day is reported."""
    written = tape_files.read_parquet(spark, _exported(spark, sf_dir, "parquet")).where(F.col("day") != F.lit("2024-01-07").cast("date"))
    return tape_files.verify(written, samples.trades(spark, sf_dir), ntz(NOW)).select("instrument", "contract_id", "day", "source_rows", "file_rows")


@query
def export_pending_days(spark, sf_dir):
    t = samples.trades(spark, sf_dir)
    days = tape_files.pending_days(t, samples.tape_coverage(spark, sf_dir), tape.footprint(t, 60), samples.export_receipts(spark, sf_dir), ntz(NOW), ntz(samples.OPEN_END))
    return days.select("instrument", "day")


@query
def tape_import(spark, sf_dir):
    t = samples.trades(spark, sf_dir)
    key = ["venue", "instrument", "contract_id", "trade_time_utc", "sequence"]
    new = maintenance.append_missing(t.where("sequence % 3 <> 0"), t.unionByName(t.where("sequence % 5 = 0")), key)
    return new.select("instrument", "contract_id", "trade_time_utc", "sequence", "price", "size")


def _changed_bars(spark, sf_dir):
    b = samples.bars(spark, sf_dir)
    hour = F.hour("bucket_start")
    return b.where(hour != 3).withColumn("volume", F.when(hour % 5 == 0, F.col("volume") + 1).otherwise(F.col("volume"))).withColumn("contract_id", F.when(hour == 7, None).otherwise(F.col("contract_id")))


_PRICES = ["open", "high", "low", "close", "volume", "contract_id"]


@query
def bars_upsert(spark, sf_dir):
    _, changed = maintenance.upsert(_changed_bars(spark, sf_dir), samples.bars(spark, sf_dir), [*series.SERIES, "bucket_start"], _PRICES)
    return changed.select("instrument", "bucket_start", "volume", "contract_id", "change")


def _session_bars(spark, sf_dir, now=NOW, gappy=False):
    make = samples.bars_gappy if gappy else samples.bars
    # stored: Spark would test each print, not each bar, for the calendar's filter on the grid that bars are joined with
    both = stored(make(spark, sf_dir).unionByName(make(spark, sf_dir, 30)), "bars")
    windows = calendars.session_windows(_dates(spark, sf_dir), CAL)
    t = samples.trades(spark, sf_dir).agg(F.min("trade_time_utc").alias("a"), F.max("trade_time_utc").alias("b"))
    windows = windows.crossJoin(F.broadcast(t)).where("end_utc > a and start_utc <= b").drop("a", "b")
    return sessions.session_bars(both, windows, CAL, ntz(now))


@query
def session_bars_upsert(spark, sf_dir):
    """Stored: an older pass, whose last days were not closed and of which one window has since changed."""
    now = _session_bars(spark, sf_dir).where("absence is null")
    old = _session_bars(spark, sf_dir, "2024-01-20 00:00:00", gappy=True).where("absence is null").withColumn("base_minutes", F.when(F.col("session") == "asia", 15).otherwise(F.col("base_minutes")))
    keys = ["venue", "instrument", "session", "trade_date"]
    d = maintenance.diff(now, old, keys, ["start_utc", "end_utc", "base_minutes", *_PRICES])
    return d.groupBy("instrument", "session", "change").agg(F.count("*").alias("rows"))


@query
def notes_append(spark, sf_dir):
    n = samples.notes(spark, sf_dir).withColumn("instrument", F.when(F.col("id") % 3 == 0, " es ").when(F.col("id") % 3 == 1, "nq").otherwise(F.col("instrument"))).withColumn("kind", F.when(F.col("id") % 4 == 0, None).otherwise(F.upper("kind")))
    return notes.append(n, samples.instruments(spark)).select("id", "instrument", "kind", F.length("text").cast("long").alias("text_length"), "recorded_at", "content_hash")


# --- column functions ---------------------------------------------------------------------------------------------------


@query
def bucket_align(spark, sf_dir):
    t = samples.trades(spark, sf_dir)
    return t.select("sequence", align_down("trade_time_utc", 60).alias("hour"), align_up("trade_time_utc", 60).alias("hour_up"), align_down("trade_time_utc", 660).alias("eleven_hours"), align_down("trade_time_utc", 5).alias("five_minutes"))


@query
def trade_date(spark, sf_dir):
    t = samples.trades(spark, sf_dir)
    return t.groupBy("instrument", CAL.trade_date("trade_time_utc").alias("trade_date")).agg(F.count("*").alias("prints"), F.sum("size").alias("volume"))


@query
def expected_bucket(spark, sf_dir):
    b = samples.bars(spark, sf_dir)
    return b.select("instrument", "bucket_start", CAL.is_expected("bucket_start", 60).alias("expected"))


@query
def product_sessions(spark, sf_dir):
    return calendars.product_sessions(_dates(spark, sf_dir), CAL).select("trade_date", "open_utc", "close_utc")


@query
def session_windows(spark, sf_dir):
    return calendars.session_windows(_dates(spark, sf_dir), CAL).select("session", "trade_date", "start_utc", "end_utc")


@query
def session_trade_dates(spark, sf_dir):
    w = calendars.session_windows(_dates(spark, sf_dir), CAL)
    return calendars.session_trade_dates(w, ntz("2024-01-10 09:00:00"), ntz("2024-01-19 12:00:00"))


@query
def session_state(spark, sf_dir):
    asks = samples.trades(spark, sf_dir).select("sequence", F.col("trade_time_utc").alias("at_utc"))
    return calendars.session_state(asks, _dates(spark, sf_dir), CAL)


@query
def contract_candidates(spark, sf_dir):
    d = calendars.product_sessions(_dates(spark, sf_dir), CAL).select("trade_date")
    return contracts.candidates(d, "HMUZ", 3).select("trade_date", "position", "expiry")


@query
def tick_money(spark, sf_dir):
    b = samples.bars(spark, sf_dir).join(F.broadcast(samples.instruments(spark)), F.col("instrument") == F.col("symbol"))
    ticks = fc.ticks_between(F.col("open"), F.col("close"), F.col("tick_size"))
    middle = (F.col("open") + F.col("close")) / 2
    return b.select("instrument", "bucket_start", ticks.alias("ticks"), ((F.col("close") - F.col("open")) * F.col("point_value")).alias("money"), fc.round_to_tick(middle, F.col("tick_size")).alias("middle"), (F.col("tick_size") * F.col("point_value")).alias("tick_value"))


@query
def account_stage(spark, sf_dir):
    c = raw(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    key = k.cast("string")
    names = F.when(k % 6 == 0, F.concat(F.lit("prac-v2-"), key)).when(k % 6 == 1, F.concat(F.lit("EXPRESS-"), key)).when(k % 6 == 2, F.concat(F.lit(" 50KTC-"), key)).when(k % 6 == 3, F.lit("PRACTICEJUL3")).when(k % 6 == 4, F.lit("S1JUL4")).otherwise(F.concat(F.lit("other"), key))
    return c.select(k.alias("account_id"), fc.account_stage(names).alias("stage"))


@query
def signed_positions(spark, sf_dir):
    o = raw(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("position_id")).agg(F.sum("l_quantity").cast("long").alias("size"))
    side = F.when(F.col("position_id") % 4 == 0, "long").when(F.col("position_id") % 4 == 1, "short").when(F.col("position_id") % 4 == 2, "flat").otherwise("long")
    return accounts.signed_positions(o.withColumn("side", side).withColumn("size", F.when(F.col("position_id") % 8 == 2, 0).otherwise(F.col("size")).cast("long"))).select("position_id", "side", "size", "signed", "error")


@query
def fills_window(spark, sf_dir):
    item = raw(spark, sf_dir, "lineitem")
    f = item.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_shipdate").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("l_linestatus") == "O", "bid").when(F.col("l_returnflag") == "R", "ask").otherwise("?").alias("side"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("double")).alias("fees"), F.when(F.col("l_returnflag") == "A", True).alias("voided"), F.col("l_extendedprice").cast("double").alias("pnl"),
    )
    return accounts.fills_window(f, ntz("1995-01-01"), ntz("1996-01-01"))


@query
def bucket_overhang(spark, sf_dir):
    b = samples.bars(spark, sf_dir)
    return calendars.overhangs(b, _dates(spark, sf_dir), CAL, [30, 60, 240])


@query
def series_guard(spark, sf_dir):
    b = samples.bars_unknown(spark, sf_dir)
    arrival = F.row_number().over(Window.partitionBy(*series.SERIES).orderBy("bucket_start"))
    b = b.withColumn("n", arrival).withColumn("arrival", F.when(F.col("n") % 50 == 0, F.col("n") + 2).otherwise(F.col("n") * 1) * 2 + F.when(F.col("n") % 50 == 0, 1).otherwise(0))
    return series.series_guard(b).select("instrument", F.col("arrival").cast("long").alias("arrival"), "bucket_start", "violation")


@query
def utc_day(spark, sf_dir):
    t = samples.trades(spark, sf_dir)
    return tape_files.finished(t, "trade_time_utc", ntz("2024-01-28 12:00:00")).groupBy("day").agg(F.count("*").alias("prints"))


# --- joins --------------------------------------------------------------------------------------------------------------


def _gaps(spark, sf_dir):
    grid = calendars.expected_grid(_dates(spark, sf_dir), CAL, 60)
    span = samples.trades(spark, sf_dir).agg(F.date_trunc("DAY", F.min("trade_time_utc")).cast("timestamp_ntz").alias("a"), F.date_trunc("DAY", F.max("trade_time_utc")).cast("timestamp_ntz").alias("b"))
    grid = grid.crossJoin(F.broadcast(span)).where("bucket_start >= a and bucket_start < b")
    # stored for the same reason as in _session_bars
    b = stored(samples.bars_gappy(spark, sf_dir), "bars")
    hidden = F.hour("bucket_start") == 4
    return intervals.bar_gaps(b.withColumn("contract_id", F.when(~hidden, F.col("contract_id"))), grid, 60)


@query
def bar_gaps(spark, sf_dir):
    return _gaps(spark, sf_dir).select("instrument", "range_start", "range_end", "buckets")


@query
def bar_gap_ranges(spark, sf_dir):
    g = _gaps(spark, sf_dir)
    return g.groupBy("instrument").agg(F.count("*").alias("ranges"), F.sum("buckets").alias("buckets"), F.min("range_start").alias("first_start"), F.max("range_end").alias("last_end"))


def _stored_values(spark, sf_dir):
    """Stored indicator values that have drifted from what is produced."""
    made = maintenance.rounded(indicators.catalogue(samples.bars(spark, sf_dir), CAL))
    hour = F.timestamp_diff("HOUR", ntz("1970-01-01"), F.col("bucket_start"))
    kept = made.where(hour % 11 != 0).withColumn("value", F.when(hour % 13 == 0, F.col("value") + 1).otherwise(F.col("value")))
    average = made.where("indicator = 'sma'")
    retired = average.where(hour % 50 == 0).withColumn("period", F.lit(99))
    orphaned = average.where(hour % 60 == 0).withColumn("bucket_start", plus_minutes("bucket_start", 30))
    return kept.unionByName(retired).unionByName(orphaned)


def _averages(spark, sf_dir):
    """Two cheap indicators with orphans: enough for reading as of a time."""
    b = samples.bars(spark, sf_dir)
    hour = F.timestamp_diff("HOUR", ntz("1970-01-01"), F.col("bucket_start"))
    made = maintenance.rounded(indicators.catalogue(b, CAL, [("sma", 20), ("vwap_rolling", 20)]))
    orphaned = made.where("indicator = 'sma'").where(hour % 60 == 0).withColumn("bucket_start", plus_minutes("bucket_start", 30))
    return b, made.unionByName(orphaned)


@query
def indicator_series(spark, sf_dir):
    b, v = _averages(spark, sf_dir)
    return asof.indicator_series(v, b).where("indicator = 'sma'").select("instrument", "bucket_start", F.round("value", 6).alias("value"))


@query
def indicator_asof(spark, sf_dir):
    b, v = _averages(spark, sf_dir)
    asks = samples.trades(spark, sf_dir).select(
        F.col("sequence").alias("ask_id"), "venue", "instrument", F.lit(60).alias("resolution_minutes"), F.when(F.col("sequence") % 2 == 0, "sma").otherwise("vwap_rolling").alias("indicator"), F.lit(20).alias("period"), F.col("trade_time_utc").alias("as_of_utc")
    )
    return asof.values_asof(asks, v, b).select("ask_id", "instrument", "indicator", "bucket_start", F.round("value", 6).alias("value"), "contract_id")


@query
def indicator_latest(spark, sf_dir):
    b, v = _averages(spark, sf_dir)
    return asof.latest_values(v, b, ntz(AS_OF)).select("instrument", "indicator", "period", "bucket_start", F.round("value", 6).alias("value"), "contract_id")


def _session_closes(spark, sf_dir):
    """Session bars as a series of their own: keyed by the session's open. They are read more than once, so they are stored."""
    s = stored(_session_bars(spark, sf_dir).where("absence is null"), "session-bars")
    return s, s.select("venue", F.concat_ws("/", "instrument", "session").alias("instrument"), F.lit(0).alias("resolution_minutes"), F.col("start_utc").alias("bucket_start"), *_PRICES)


@query
def session_indicator_asof(spark, sf_dir):
    s, bars = _session_closes(spark, sf_dir)
    v = indicators.catalogue(bars, CAL, [("sma", 3)])
    v = v.withColumn("session", F.element_at(F.split("instrument", "/"), 2)).withColumn("instrument", F.element_at(F.split("instrument", "/"), 1))
    return asof.session_values_asof(v, s, ntz(AS_OF)).select("instrument", "session", "indicator", "period", "bucket_start", F.round("value", 6).alias("value"))


def _windows(spark, sf_dir):
    p = calendars.product_sessions(_dates(spark, sf_dir), CAL)
    keys = samples.tape_coverage(spark, sf_dir).select("venue", "instrument", "contract_id").distinct()
    return p.crossJoin(F.broadcast(keys)).select("venue", "instrument", "contract_id", "trade_date", F.col("open_utc").alias("window_start"), F.col("close_utc").alias("window_end"))


_KEY = ["venue", "instrument", "contract_id"]


@query
def coverage_overlap(spark, sf_dir):
    pairs = intervals.overlapping(samples.tape_coverage(spark, sf_dir), _windows(spark, sf_dir), _KEY, ntz("2024-02-15"))
    return pairs.select("instrument", "contract_id", "trade_date", "range_start", "range_end")


def _memo(spark, sf_dir):
    """Empty ranges of both contracts, some of them remembered for a while only."""
    g = _gaps(spark, sf_dir).select("venue", "instrument", "range_start", "range_end")
    code = F.when(F.col("instrument") == "ES", "EP").otherwise("ENQ")
    month = F.explode(F.array(F.lit("H24"), F.lit("M24"))).alias("month")
    rows = g.select("*", month).withColumn("contract_id", F.concat(F.lit("CON.F.US."), code, F.lit("."), "month"))
    hour = F.timestamp_diff("HOUR", ntz("1970-01-01"), F.col("range_start"))
    rows = rows.where((F.col("month") == "H24") | (hour % 2 == 0))
    return rows.withColumn("expires_at", F.when(F.col("month") == "M24", plus_minutes("range_end", 60 * 24 * 10))).drop("month")


@query
def ranges_answered(spark, sf_dir):
    g = _gaps(spark, sf_dir)
    code = F.when(F.col("instrument") == "ES", "EP").otherwise("ENQ")
    hour = F.timestamp_diff("HOUR", ntz("1970-01-01"), F.col("range_start"))
    both = F.array(F.concat(F.lit("CON.F.US."), code, F.lit(".H24")), F.concat(F.lit("CON.F.US."), code, F.lit(".M24")))
    slices = g.select(F.concat_ws("@", "instrument", F.col("range_start").cast("string")).alias("slice_id"), "venue", "instrument", F.col("range_start").alias("slice_start"), F.col("range_end").alias("slice_end"), F.when(hour % 7 == 0, F.array().cast("array<string>")).when(hour % 3 == 0, F.slice(both, 1, 1)).otherwise(both).alias("candidates"))
    out = intervals.answered(slices, _memo(spark, sf_dir), ntz(AS_OF))
    return out.select("instrument", "slice_start", "slice_end", F.size("candidates").cast("long").alias("candidates"), "answered")


@query
def receipt_source_counts(spark, sf_dir):
    r = maintenance.source_counts(samples.export_receipts(spark, sf_dir), samples.trades(spark, sf_dir))
    return r.select("instrument", "contract_id", "day", F.col("row_count").cast("long").alias("row_count"), "source_rows", "last_recorded")


@query
def receipts_missing(spark, sf_dir):
    return maintenance.receipts_missing(samples.export_receipts(spark, sf_dir), samples.trades(spark, sf_dir)).select("instrument", "contract_id", "day", "source_rows")


@query
def notes_unsearchable(spark, sf_dir):
    n = notes.unsearchable(samples.notes(spark, sf_dir), samples.note_vectors(spark, sf_dir), "m1")
    return n.groupBy("kind").agg(F.count("*").alias("notes"))


@query
def bars_overlapping_window(spark, sf_dir):
    b = samples.bars(spark, sf_dir)
    hit = (F.col("bucket_start") < ntz("2024-01-11 08:15:00")) & (plus_minutes("bucket_start", 60) > ntz("2024-01-10 03:30:00"))
    return b.where(hit).select(*BAR)


def _front(spark, sf_dir):
    t = samples.trades(spark, sf_dir)
    return t, tape.volume_front(tape.session_contract_volume(t, CAL))


@query
def contract_roll_seam(spark, sf_dir):
    t, front = _front(spark, sf_dir)
    flips = tape.front_flip(t, front, CAL).where("flipped_at is not null")
    out = contracts.roll_seam(samples.bars(spark, sf_dir), flips, ntz(AS_OF))
    return out.select("instrument", F.col("run_id").cast("long").alias("run_id"), "contract_id", "first_bucket", "last_bucket", "bars")


@query
def notes_embedding_reuse(spark, sf_dir):
    return notes.reuse_vectors(samples.notes(spark, sf_dir), samples.note_vectors(spark, sf_dir), "m1")


# --- aggregates ---------------------------------------------------------------------------------------------------------


@query
def footprint(spark, sf_dir):
    return tape.footprint(samples.trades(spark, sf_dir), 60).select("instrument", "bucket_start", "price", "buy_volume", "sell_volume")


def _ladder(spark, sf_dir):
    cells = tape.footprint(samples.trades(spark, sf_dir), 60).withColumn("day", F.to_date("bucket_start"))
    return tape.volume_ladder(cells, ["venue", "instrument", "day"])


_LADDER = ["venue", "instrument", "day"]


@query
def volume_ladder(spark, sf_dir):
    return _ladder(spark, sf_dir).select("instrument", "day", "price", "volume")


@query
def point_of_control(spark, sf_dir):
    return tape.point_of_control(_ladder(spark, sf_dir), _LADDER).select("instrument", "day", "price", "volume")


@query
def value_area(spark, sf_dir):
    return tape.value_area(_ladder(spark, sf_dir), _LADDER).drop("venue")


@query
def session_bars(spark, sf_dir):
    s = _session_bars(spark, sf_dir, "2024-01-29 12:00:00", gappy=True)
    return s.select("instrument", "session", "trade_date", "expected", "open", "high", "low", "close", "volume", "contract_id", "absence", "missing")


@query
def session_contract_volume(spark, sf_dir):
    return tape.session_contract_volume(samples.trades(spark, sf_dir), CAL).select("instrument", "trade_date", "contract_id", "volume")


@query
def volume_front(spark, sf_dir):
    return _front(spark, sf_dir)[1].drop("venue")


@query
def front_flip_instant(spark, sf_dir):
    t, front = _front(spark, sf_dir)
    return tape.front_flip(t, front, CAL).drop("venue")


@query
def front_vs_gateway(spark, sf_dir):
    t, front = _front(spark, sf_dir)
    picks = t.groupBy("venue", "instrument").agg(F.max_by("contract_id", F.struct("trade_time_utc", "sequence")).alias("picked")).where("instrument <> 'NQ'")
    return tape.front_vs_gateway(front, picks).drop("venue")


@query
def historical_contract(spark, sf_dir):
    by = samples.bars_by_contract(spark, sf_dir)
    day = CAL.trade_date("bucket_start")
    stored = by.withColumn("trade_date", day).where("trade_date is not null and dayofmonth(trade_date) % 4 = 0").groupBy("venue", "instrument", "trade_date").agg(F.max("contract_id").alias("stored"))
    choices, _ = tape.historical_contract(by, CAL, stored)
    return choices.select("instrument", "trade_date", "contract_id", "volume", "offered")


@query
def last_tick(spark, sf_dir):
    return tape.last_tick(samples.trades(spark, sf_dir), ntz("2024-01-05"), ntz("2024-01-20")).drop("venue")


@query
def contract_coverage(spark, sf_dir):
    es = samples.bars(spark, sf_dir).where("instrument = 'ES'")
    nq = samples.bars_unknown(spark, sf_dir).where("instrument = 'NQ'")
    early = samples.bars_unknown(spark, sf_dir).where(F.col("bucket_start") < ntz("2024-01-12")).withColumn("resolution_minutes", F.lit(61))
    single = samples.bars(spark, sf_dir).where(F.col("bucket_start") < ntz("2024-01-12")).withColumn("resolution_minutes", F.lit(62))
    return series.contract_coverage(es.unionByName(nq).unionByName(early).unionByName(single)).drop("venue")


@query
def available_range(spark, sf_dir):
    b = samples.bars_gappy(spark, sf_dir).where(F.col("bucket_start") >= ntz("2024-01-09 05:00:00"))
    return series.available_range(b).drop("venue")


@query
def tie_days(spark, sf_dir):
    by = samples.bars_by_contract(spark, sf_dir)
    return tape.tie_days(by.withColumn("volume", F.lit(1).cast("long")), CAL).select("instrument", "trade_date", "leaders", "volume")


@query
def newest_per_indicator(spark, sf_dir):
    _, v = _averages(spark, sf_dir)
    return v.groupBy("instrument", "indicator", "period").agg(F.max("bucket_start").alias("newest"))


@query
def contract_cap_usage(spark, sf_dir):
    e = raw(spark, sf_dir, "events")
    audit = e.select(F.col("user_id").alias("account_id"), F.col("ts").cast("timestamp_ntz").alias("at_utc"), F.when(F.col("event_type") == "purchase", "Attempted").otherwise("Refused").alias("outcome"), F.get_json_object("props", "$.k").cast("long").alias("contracts"))
    return accounts.cap_usage(audit, CAL)


# --- series and indicators ----------------------------------------------------------------------------------------------


@query
def contract_segments(spark, sf_dir):
    return series.contract_segments(samples.bars_unknown(spark, sf_dir)).select("instrument", F.col("run_id").cast("long").alias("run_id"), "contract_id", "first_bucket", "last_bucket", "bars")


@query
def newest_segment(spark, sf_dir):
    return series.newest_segment(samples.bars(spark, sf_dir)).select(*BAR)


def _indicator(name: str, make: Callable[[DataFrame], DataFrame], column: str = "value") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = make(samples.bars_unknown(spark, sf_dir))
        return rows.select("instrument", "bucket_start", F.round(column, 6).alias("value")).where("value is not null")

    run.__name__ = name
    query(run)


_indicator("sma", indicators.sma)
_indicator("ema", indicators.ema)
_indicator("macd", indicators.macd, "line")
_indicator("macd_signal", indicators.macd, "signal")
_indicator("macd_histogram", indicators.macd, "histogram")
_indicator("bb_middle", indicators.bollinger, "middle")
_indicator("bb_upper", indicators.bollinger, "upper")
_indicator("bb_lower", indicators.bollinger, "lower")
_indicator("atr", indicators.atr)
_indicator("rsi", indicators.rsi)
_indicator("plus_di", indicators.directional, "plus_di")
_indicator("minus_di", indicators.directional, "minus_di")
_indicator("adx", indicators.directional, "adx")
_indicator("vwap", lambda b: indicators.vwap(b, CAL))
_indicator("vwap_rolling", indicators.vwap_rolling)


@query
def indicator_catalogue(spark, sf_dir):
    made = indicators.catalogue(samples.bars(spark, sf_dir), CAL)
    return made.select("instrument", "bucket_start", "indicator", F.col("period").cast("long").alias("period"), F.round("value", 6).alias("value"))


@query
def heikin_ashi(spark, sf_dir):
    rows = indicators.heikin_ashi(samples.bars(spark, sf_dir))
    return rows.select("instrument", "bucket_start", *[F.round(c, 6).alias(c) for c in ("ha_open", "ha_close", "body_high", "body_low")])


@query
def swing_pivots(spark, sf_dir):
    rows = levels.swing_pivots(samples.bars(spark, sf_dir), SMALL, series.BLOCK_ROWS)
    return rows.select("instrument", "bucket_start", "price", "kind", "prominence")


@query
def coverage_gaps(spark, sf_dir):
    w = _windows(spark, sf_dir)
    touching = intervals.overlapping(samples.tape_coverage(spark, sf_dir), w, _KEY, ntz("2024-02-15"))
    return intervals.complement(touching, w, _KEY).select("instrument", "contract_id", "window_start", "gap_start", "gap_end")


@query
def interval_union(spark, sf_dir):
    c = samples.tape_coverage(spark, sf_dir)
    wide = c.where(F.col("range_end") < ntz("2025-01-01")).withColumn("range_end", plus_minutes("range_end", 90))
    return intervals.union(wide, _KEY).select("instrument", "contract_id", "range_start", "range_end")


@query
def covered_window(spark, sf_dir):
    return intervals.covered_window(samples.tape_coverage(spark, sf_dir), ntz("2024-01-08 12:00:00"), ntz("2024-01-22")).drop("venue")


def _tenure(spark, sf_dir):
    b = samples.bars_unknown(spark, sf_dir)
    front = b.groupBy("venue", "instrument").agg(F.max_by("contract_id", "bucket_start").alias("front"))
    return contracts.tenure_start(b, front, ntz(NOW))


@query
def tenure_start(spark, sf_dir):
    return _tenure(spark, sf_dir).select("instrument", "front", "tenure_start")


def _slices(spark, sf_dir):
    t = _tenure(spark, sf_dir).select("venue", "instrument", "front", "tenure_start")
    gaps = t.select("venue", "instrument", F.explode(F.array(F.struct(ntz("2023-12-05 03:00:00").alias("s"), ntz("2024-01-05").alias("e")), F.struct(ntz("2024-01-15").alias("s"), ntz("2024-01-18 06:00:00").alias("e")))).alias("x")).select("venue", "instrument", F.col("x.s").alias("range_start"), F.col("x.e").alias("range_end"))
    parts = samples.trades(spark, sf_dir).select("instrument", "contract_id").distinct().withColumn("expiry", F.element_at(F.split("contract_id", r"\."), -1))
    return contracts.candidate_slices(gaps, t, CAL, parts.select("instrument", "expiry", "contract_id"))


@query
def candidate_slices(spark, sf_dir):
    s = _slices(spark, sf_dir)
    return s.select("instrument", "slice_start", "slice_end", F.concat_ws(",", "candidates").alias("candidates"), F.concat_ws(",", "unresolved").alias("unresolved"))


@query
def history_selection(spark, sf_dir):
    return contracts.history_selection(_slices(spark, sf_dir)).select("instrument", F.col("rank").cast("long").alias("rank"), F.concat_ws(",", "unresolved").alias("unresolved"), "slices")


def _range_mean(bars, n):
    """A caller's own indicator: the mean range of a run's last n bars."""
    w = series.over_run()
    return bars.withColumn("value", F.when(F.row_number().over(w) >= n, F.avg(F.col("high") - F.col("low")).over(series.rows_before(n))))


@query
def indicator_extension(spark, sf_dir):
    made = indicators.catalogue(samples.bars_unknown(spark, sf_dir), CAL, [("sma", 20)], {("range_mean", 10): _range_mean})
    return made.select("instrument", "bucket_start", "indicator", F.col("period").cast("long").alias("period"), F.round("value", 6).alias("value"))


@query
def seeded_mean(spark, sf_dir):
    """A smoothing of a series with holes: seeded on its first values, ended by the first hole after them."""
    rows = series.with_runs(samples.bars_unknown(spark, sf_dir))
    n = F.row_number().over(series.over_run())
    hole = (n <= 2) | ((F.dayofmonth("bucket_start") % 5 == 0) & (F.hour("bucket_start") == 13) & (n > 7))
    made = recurrence.scan(rows.withColumn("x", F.when(~hole, F.col("close"))), series.RUN, "bucket_start", [recurrence.Smooth("y", "x", 5, 2 / 6)])
    return made.select("instrument", "bucket_start", F.round("y", 6).alias("value")).where("value is not null")


# --- levels -------------------------------------------------------------------------------------------------------------


def _zone_columns(zones):
    return zones.select("instrument", *[F.round(c, 6).alias(c) for c in ("bottom", "top", "significance")], "kind", "formed_at", "touches", "period")


def _level_bars(spark, sf_dir, lookback=None):
    """The newest run of each series (of its last `lookback` bars) and its average range: a stored table, as every method reads it."""
    bars = samples.bars(spark, sf_dir)
    made = indicators.atr(series.newest_segment(bars if lookback is None else series.latest(bars, lookback)).drop("run_id"), block_rows=None)
    path = scratch(spark, "level-bars")
    made.write.parquet(path)
    rows = spark.read.schema(made.schema).parquet(path)
    return rows.drop("value", "run_id"), rows.select(*series.SERIES, "bucket_start", F.col("value").alias("atr"))


def _zones(spark, sf_dir):
    b, scale = _level_bars(spark, sf_dir)
    return b, scale, levels.zones_from_pivots(levels.swing_pivots(b, SMALL), scale, SMALL)


@query
def zones_from_pivots(spark, sf_dir):
    return _zone_columns(_zones(spark, sf_dir)[2])


@query
def merge_zones(spark, sf_dir):
    return _zone_columns(levels.merge_zones(_zones(spark, sf_dir)[2], levels.KEYS))


@query
def zone_width_cap(spark, sf_dir):
    return _zone_columns(levels.width_cap(_zones(spark, sf_dir)[2], 60.0))


@query
def relabel_zones(spark, sf_dir):
    b, _, z = _zones(spark, sf_dir)
    return _zone_columns(levels.relabel(z, levels.last_closes(b)))


@query
def zone_level_cap(spark, sf_dir):
    return _zone_columns(levels.level_cap(_zones(spark, sf_dir)[2], levels.KEYS, 12))


@query
def levels_swing(spark, sf_dir):
    b, scale = _level_bars(spark, sf_dir)
    return _zone_columns(levels.levels_swing(b, scale, SMALL))


@query
def levels_swing_default(spark, sf_dir):
    """Swing zones as they are found by default, 20 and 15 bars around and on Heikin-Ashi bodies, however slight."""
    b, scale = _level_bars(spark, sf_dir)
    return _zone_columns(levels.zones_from_pivots(levels.swing_pivots(b), scale, levels.Options(min_significance=0.0)))


def _pivot(formula: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, scale = _level_bars(spark, sf_dir)
        return _zone_columns(levels.levels_pivot(b, scale, CAL, formula, SMALL))

    run.__name__ = f"levels_pivot_{formula}"
    query(run)


for _formula in levels.FORMULAS:
    _pivot(_formula)


@query
def levels_session(spark, sf_dir):
    b, scale = _level_bars(spark, sf_dir)
    return _zone_columns(levels.levels_session(b, scale, CAL, SMALL))


def _profile(spark, sf_dir):
    cells = tape.footprint(samples.trades(spark, sf_dir), 60).where(F.col("bucket_start") >= ntz("2024-01-24"))
    ladder = tape.volume_ladder(cells, ["venue", "instrument"])
    return ladder, tape.value_area(ladder, ["venue", "instrument"])


def _volume(kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b, scale = _level_bars(spark, sf_dir)
        return _zone_columns(levels.levels_volume(b, scale, *_profile(spark, sf_dir), kind, SMALL))

    run.__name__ = f"levels_volume_{kind}"
    query(run)


for _kind in ("poc", "vah", "val", "traded"):
    _volume(_kind)


def _level_set(spark, sf_dir):
    b, scale = _level_bars(spark, sf_dir)
    return levels.level_set(b, scale, CAL, *_profile(spark, sf_dir), SMALL)


@query
def confluence(spark, sf_dir):
    return levels.confluence(_level_set(spark, sf_dir), {"swing": 2.0, "volume-poc": 1.5}).select("instrument", "score", "methods")


@query
def level_set(spark, sf_dir):
    z = _level_set(spark, sf_dir)
    return z.select("instrument", "method", "kind", F.round("bottom", 6).alias("bottom"), F.round("top", 6).alias("top"), F.round("significance", 6).alias("significance"), "touches")


_WEIGHTED = replace(SMALL, weights={"swing": 2.0, "volume-poc": 1.5})


def _refused(spark, sf_dir, bars, minutes, start, methods=levels.METHODS):
    window = intervals.covered_window(samples.tape_coverage(spark, sf_dir), ntz(start), ntz("2024-02-01"))
    return levels.refusals(calendars.series_overhangs(bars, _dates(spark, sf_dir), CAL, [minutes]), window, methods)


@query
def level_methods(spark, sf_dir):
    """What each method gave to bars of an hour, over a long and a short window of tape, and to bars of four hours, whose last bucket overhangs the close."""
    b, scale = _level_bars(spark, sf_dir)
    zones = levels.level_set(b, scale, CAL, *_profile(spark, sf_dir), SMALL)
    path = scratch(spark, "level-set")
    zones.write.parquet(path)
    zones = spark.read.schema(zones.schema).parquet(path)
    reports = [levels.method_report(b, zones, _refused(spark, sf_dir, b, 60, start), options=_WEIGHTED).withColumn("tape_from", ntz(start)) for start in ("2024-01-24", "2024-01-31 23:30:00")]
    anchored = ("session", "pivot-classic")
    b4 = samples.bars(spark, sf_dir, 240)
    four = levels.session_lines(b4, indicators.atr(b4, block_rows=None).withColumnRenamed("value", "atr"), CAL, SMALL).withColumn("method", F.lit("session"))
    reports.append(levels.method_report(b4, four, _refused(spark, sf_dir, b4, 240, "2024-01-24", anchored), anchored, _WEIGHTED).withColumn("tape_from", ntz("2024-01-24")))
    rows = reduce(DataFrame.unionByName, reports)
    return rows.select("instrument", F.col("resolution_minutes").cast("long").alias("resolution_minutes"), "tape_from", "method", "family", "weight", "zones", "capped", "absence")


@query
def level_set_ordered(spark, sf_dir):
    """The level set without what is refused, from the lowest level to the highest."""
    b, _ = _level_bars(spark, sf_dir)
    z = levels.in_order(levels.allowed(_level_set(spark, sf_dir), _refused(spark, sf_dir, b, 60, "2024-01-24")))
    return z.select("instrument", "position", "method", F.round("midpoint", 6).alias("midpoint"))


def _round_numbers(bars, scales, options):
    """A caller's own level method: the next whole number over the last close."""
    last = bars.groupBy(*levels.KEYS).agg(F.max_by("close", "bucket_start").alias("c"), F.max("bucket_start").alias("formed_at"))
    price = F.ceil("c").cast("double")
    return last.select(
        *levels.KEYS, (price - 0.25).alias("bottom"), (price + 0.25).alias("top"), F.lit("Support").alias("kind"), "formed_at",
        F.lit(1).cast("long").alias("touches"), F.lit(1.0).alias("significance"), F.lit(None).cast("string").alias("period"),
    )


@query
def level_extension(spark, sf_dir):
    b, scale = _level_bars(spark, sf_dir)
    z = levels.level_set(b, scale, CAL, *_profile(spark, sf_dir), SMALL, {"round-number": _round_numbers}).where("method = 'round-number'")
    return z.select("instrument", "method", "family", "kind", F.round("bottom", 6).alias("bottom"), F.round("top", 6).alias("top"), "touches")


@query
def market_snapshot(spark, sf_dir):
    """Per instrument: session state, newest bar, newest value of every indicator, number of levels."""
    b = samples.bars(spark, sf_dir)
    last = b.groupBy("instrument").agg(F.max_by(F.struct("bucket_start", "close", "volume"), "bucket_start").alias("x")).select("instrument", "x.*")
    state = calendars.session_state(last.select("instrument", F.col("bucket_start").alias("at_utc")), _dates(spark, sf_dir), CAL)
    values = asof.latest_values(indicators.catalogue(b, CAL), b, ntz(NOW)).groupBy("instrument").agg(F.count("*").alias("indicators"), F.round(F.max(F.when(F.col("indicator") == "sma", F.col("value"))), 6).alias("sma"))
    zones = levels.levels_swing(*_level_bars(spark, sf_dir, SNAPSHOT_BARS), SMALL).groupBy("instrument").agg(F.count("*").alias("levels"))
    out = last.join(state.drop("at_utc"), "instrument").join(values, "instrument", "left").join(zones, "instrument", "left")
    return out.select("instrument", "bucket_start", "close", "volume", "is_open", "trade_date", "next_open_utc", "indicators", "sma", F.coalesce("levels", F.lit(0)).cast("long").alias("levels"))


# --- order, limits, sets ------------------------------------------------------------------------------------------------


@query
def front_month_order(spark, sf_dir):
    c = samples.trades(spark, sf_dir).groupBy("instrument", "contract_id").agg((F.max("size") % 2 == 0).alias("active"))
    odd = c.select("instrument", F.concat("contract_id", F.lit("?")).alias("contract_id"), F.lit(False).alias("active"))
    return contracts.front_month_order(c.unionByName(odd)).withColumn("position", F.col("position").cast("long"))


@query
def last_closed_sessions(spark, sf_dir):
    w = calendars.session_windows(_dates(spark, sf_dir), CAL)
    return calendars.last_closed(w, ntz(AS_OF), 5)


def _vector_queries(spark, sf_dir):
    """A stated query set: the vectors of every twentieth note."""
    return samples.note_vectors(spark, sf_dir).where("owner_id % 20 = 0").select(F.col("owner_id").alias("query_id"), F.col("embedding").alias("query"))


@query
def notes_semantic_topk(spark, sf_dir):
    found = notes.semantic_topk(samples.note_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 5, "m1")
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "owner_id", F.round("similarity", 6).alias("similarity"))


@query
def notes_text_search(spark, sf_dir):
    return notes.text_search(samples.notes(spark, sf_dir), "The", 20).select("id", "kind", "recorded_at")


@query
def series_discovery(spark, sf_dir):
    b, v = _averages(spark, sf_dir)
    extra = v.where("indicator = 'sma'").withColumn("instrument", F.concat("instrument", F.lit("-old")))
    keys = ["venue", "instrument", "resolution_minutes"]
    found = b.select(*keys).distinct().unionByName(v.unionByName(extra).select(*keys).distinct()).distinct()
    return found.select("venue", "instrument", F.col("resolution_minutes").cast("long").alias("resolution_minutes"))


@query
def bars_dedupe(spark, sf_dir):
    b = samples.bars(spark, sf_dir)
    pages = b.withColumn("page", F.lit(1)).unionByName(b.where(F.hour("bucket_start") % 4 == 0).withColumn("page", F.lit(2)).withColumn("close", F.col("close") + 1))
    w = Window.partitionBy(*series.SERIES, "bucket_start").orderBy("page")
    return pages.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(*BAR)


# --- projection and maintenance -----------------------------------------------------------------------------------------


def _produced(spark, sf_dir):
    return maintenance.rounded(indicators.catalogue(samples.bars(spark, sf_dir), CAL))


def _value_columns(rows, last):
    return rows.select("instrument", "indicator", F.col("period").cast("long").alias("period"), "bucket_start", F.round("value", 6).alias("value"), last)


@query
def indicator_project(spark, sf_dir):
    return _value_columns(maintenance.project(_produced(spark, sf_dir), _stored_values(spark, sf_dir)), "change")


@query
def indicator_reconcile(spark, sf_dir):
    found = maintenance.reconcile(_stored_values(spark, sf_dir), _produced(spark, sf_dir), samples.bars(spark, sf_dir))
    return _value_columns(found, "reason")


@query
def indicator_completeness(spark, sf_dir):
    cut = F.when(F.col("indicator").isin("sma", "rsi"), ntz("2024-01-20")).otherwise(ntz(NOW))
    stored = _stored_values(spark, sf_dir).where(F.col("bucket_start") < cut).where("indicator <> 'bb_upper'")
    out = maintenance.completeness(samples.bars(spark, sf_dir), stored)
    return out.select("instrument", "indicator", F.col("period").cast("long").alias("period"), "due_from", "newest", "missing")


@query
def indicator_rebuild(spark, sf_dir):
    made, stored, b = _produced(spark, sf_dir), _stored_values(spark, sf_dir), samples.bars(spark, sf_dir)
    changed = maintenance.project(made, stored).groupBy("instrument").agg(F.count("*").alias("changed"))
    gone = maintenance.reconcile(stored, made, b).groupBy("instrument").agg(F.count("*").alias("removed"))
    return changed.join(gone, "instrument", "full").select("instrument", F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("removed", F.lit(0)).alias("removed"))


def _stored_cells(spark, sf_dir):
    c = tape.footprint(samples.trades(spark, sf_dir), 60)
    hour = F.timestamp_diff("HOUR", ntz("1970-01-01"), F.col("bucket_start"))
    kept = c.where(hour % 11 != 0).withColumn("buy_volume", F.when(hour % 13 == 0, F.col("buy_volume") + 1).otherwise(F.col("buy_volume")))
    return kept.unionByName(c.where(hour % 17 == 0).withColumn("price", F.col("price") + 1000))


_CELL = ["venue", "instrument", "resolution_minutes", "bucket_start", "price"]


@query
def footprint_project(spark, sf_dir):
    d = maintenance.diff(tape.footprint(samples.trades(spark, sf_dir), 60), _stored_cells(spark, sf_dir), _CELL, ["buy_volume", "sell_volume"])
    return d.select("instrument", "bucket_start", "price", "buy_volume", "sell_volume", "change")


@query
def footprint_fresh(spark, sf_dir):
    cells = tape.footprint(samples.trades(spark, sf_dir), 60)
    stored = _stored_cells(spark, sf_dir).where("instrument = 'ES'").unionByName(cells.where("instrument <> 'ES'"))
    d = maintenance.diff(cells, stored, _CELL, ["buy_volume", "sell_volume"]).groupBy("venue", "instrument").agg(F.count("*").alias("n"))
    return cells.select("venue", "instrument").distinct().join(d, ["venue", "instrument"], "left").select("instrument", F.col("n").isNull().alias("fresh"))


@query
def reselect_bars(spark, sf_dir):
    # each is read for several counts
    by_contract, held, memo = stored(samples.bars_by_contract(spark, sf_dir), "contract-bars"), stored(samples.bars_unknown(spark, sf_dir), "bars"), stored(_memo(spark, sf_dir), "memo")
    return maintenance.reselect(by_contract, held, CAL, memo).drop("venue")


@query
def coverage_memo(spark, sf_dir):
    g = _memo(spark, sf_dir).drop("expires_at")
    return maintenance.coverage_memo(g, ntz("2024-01-22 06:30:00")).select("instrument", "contract_id", "range_start", "range_end", "expires_at")


@query
def retention_plan(spark, sf_dir):
    return maintenance.retention_plan(samples.export_receipts(spark, sf_dir), samples.trades(spark, sf_dir)).drop("venue")


@query
def retention_apply(spark, sf_dir):
    left = maintenance.retention_apply(samples.trades(spark, sf_dir), samples.export_receipts(spark, sf_dir))
    return left.select("instrument", "contract_id", "trade_time_utc", "sequence", "price", "size")


# --- changes written to stored tables -----------------------------------------------------------------------------------


def _committed(spark: SparkSession, held: DataFrame, changes: Callable[[DataFrame], DataFrame], keys: list[str], parts: list[str]) -> DataFrame:
    """The table after two commits, its first rows and the changes that are found against what was read back."""
    table = VersionedTable(spark, scratch(spark, "table"), held.schema, parts)
    table.commit(held.withColumn("change", F.lit("insert")), keys, "first")
    table.commit(changes(table.read()), keys, "second")
    return table.read()


_BAR_KEYS = [*series.SERIES, "bucket_start"]
_BAR_PARTS = ["instrument", "to_date(bucket_start)"]


@query
def bars_committed(spark, sf_dir):
    found = _committed(spark, _changed_bars(spark, sf_dir).select(*_BAR_KEYS, *_PRICES), lambda t: maintenance.upsert(t, samples.bars(spark, sf_dir), _BAR_KEYS, _PRICES)[1], _BAR_KEYS, _BAR_PARTS)
    return found.select(*BAR)


@query
def session_bars_committed(spark, sf_dir):
    keys, columns = ["venue", "instrument", "session", "trade_date"], ["start_utc", "end_utc", "base_minutes", *_PRICES]
    old = _session_bars(spark, sf_dir, "2024-01-20 00:00:00", gappy=True).where("absence is null").select(*keys, *columns)
    now = _session_bars(spark, sf_dir).where("absence is null")
    found = _committed(spark, old, lambda t: maintenance.diff(now, t, keys, columns), keys, ["instrument", "trade_date"])
    return found.select("instrument", "session", "trade_date", "start_utc", "end_utc", F.col("base_minutes").cast("long").alias("base_minutes"), *_PRICES)


@query
def indicators_committed(spark, sf_dir):
    found = _committed(spark, _stored_values(spark, sf_dir).select(*maintenance.VALUE, "value"), lambda t: maintenance.projection_changes(_produced(spark, sf_dir), t), maintenance.VALUE, _BAR_PARTS)
    return found.select("instrument", "indicator", F.col("period").cast("long").alias("period"), "bucket_start", F.round("value", 6).alias("value"))


@query
def reselection_committed(spark, sf_dir):
    held = samples.bars_unknown(spark, sf_dir).select(*_BAR_KEYS, *_PRICES)
    return _committed(spark, held, lambda t: maintenance.reselection_changes(samples.bars_by_contract(spark, sf_dir), t, CAL), _BAR_KEYS, _BAR_PARTS).select(*BAR)


@query
def retention_committed(spark, sf_dir):
    keys = ["venue", "instrument", "contract_id", "trade_time_utc", "sequence"]
    found = _committed(spark, samples.trades(spark, sf_dir), lambda t: maintenance.retention_changes(t, samples.export_receipts(spark, sf_dir)), keys, ["instrument", "contract_id", "to_date(trade_time_utc)"])
    return found.select("instrument", "contract_id", "trade_time_utc", "sequence", "price", "size")


# --- streams ------------------------------------------------------------------------------------------------------------


def _stream_trades(spark, sf_dir):
    """The print mapping over a stream of the events."""
    events = live.read_events(spark, sf_dir)
    return _mapped(events)


def _mapped(events):
    even = F.col("user_id") % 2 == 0
    at = F.col("ts").cast("timestamp_ntz")
    contract = F.concat(F.lit("CON.F.US."), F.when(even, "EP").otherwise("ENQ"), F.lit("."), F.when(F.col("event_id") % 30 >= F.dayofmonth(at), "H24").otherwise("M24"))
    return events.select(
        F.lit("SIM").alias("venue"), F.when(even, "ES").otherwise("NQ").alias("instrument"), contract.alias("contract_id"), at.alias("trade_time_utc"), F.col("event_id").alias("source_id"),
        (F.floor(F.col("value") * 4 + 0.5) / 4).cast("double").alias("price"), F.get_json_object("props", "$.k").cast("long").alias("size"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type").isin("view", "error"), 2).otherwise(0).alias("direction"), "event_type",
    )


@query
def source_live_prints(spark, sf_dir):
    return live.drain(_stream_trades(spark, sf_dir), "prints").select("instrument", "contract_id", "trade_time_utc", F.col("source_id").alias("sequence"), "price", "size", "direction")


@query
def stream_tape(spark, sf_dir):
    blank = F.when(F.col("source_id") % 97 == 0, F.lit(" ")).otherwise(F.col("contract_id"))
    rows = live.stream_tape(_stream_trades(spark, sf_dir).withColumn("contract_id", blank).drop("event_type"))
    return rows.select("instrument", "contract_id", "trade_time_utc", "price", "size", "sequence")


def _changes(rows):
    kind = F.when(F.col("event_type") == "signup", "connect").when(F.col("event_type") == "error", "drop")
    return rows.select("venue", "instrument", F.col("trade_time_utc").alias("at"), kind.alias("kind"), F.col("source_id").alias("event_id")).where("kind is not null")


@query
def stream_coverage(spark, sf_dir):
    return live.drain(live.stream_coverage(_changes(_stream_trades(spark, sf_dir))), "coverage").select("instrument", "range_start", "range_end")


@query
def batch_coverage(spark, sf_dir):
    return live.coverage_batch(_changes(_mapped(raw(spark, sf_dir, "events")))).select("instrument", "range_start", "range_end")


@query
def stream_print_gate(spark, sf_dir):
    passed = live.print_gate(_stream_trades(spark, sf_dir), samples.tape_coverage(spark, sf_dir).where(F.dayofmonth("range_start") % 3 != 0))
    return live.drain(passed.drop("event_type"), "gate").select("instrument", "contract_id", "trade_time_utc", F.col("source_id").alias("sequence"), "price", "size")


@query
def stream_gate_changing(spark, sf_dir):
    """Coverage is a stream too: the ranges are reported as files beside the prints."""
    path = scratch(spark, "ranges")
    samples.tape_coverage(spark, sf_dir).where(F.dayofmonth("range_start") % 3 != 0).write.parquet(path)
    ranges = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    passed = live.gate_with_changes(_stream_trades(spark, sf_dir).drop("event_type"), ranges)
    return live.drain(passed, "gate").select("instrument", "contract_id", "trade_time_utc", F.col("source_id").alias("sequence"), "price", "size")


@query
def latest_quote_state(spark, sf_dir):
    """Quotes as keyed state; rows that the watermark has passed are stale."""
    return live.drain_quotes(_stream_quotes(spark, sf_dir)).select(*_QUOTE_OUT)


_QUOTE_OUT = ["contract_id", "bid", "ask", "last", "volume", "last_at", "volume_at", "quote_time_utc", "received_at", "trade_date"]


@query
def latest_quote(spark, sf_dir):
    return live.latest_quotes(samples.quote_events(spark, sf_dir)).select(*_QUOTE_OUT)


def _stream_quotes(spark, sf_dir):
    t = _stream_trades(spark, sf_dir).where("event_type in ('view', 'click', 'purchase')")
    trade = F.col("event_type") == "purchase"
    price = F.col("price")
    return t.select(
        "venue", "instrument", "contract_id", F.col("source_id").alias("sequence"),
        F.when(trade, 0.0).otherwise(price - 0.25).alias("bid"), F.when(trade, 0.0).otherwise(price + 0.25).alias("ask"), F.when(trade, price).otherwise(0.0).alias("last"),
        F.when(trade, F.col("size")).otherwise(0).cast("long").alias("volume"), F.when(~trade, F.col("trade_time_utc")).alias("quote_time_utc"), F.col("trade_time_utc").alias("received_at"),
        F.when(trade, F.col("trade_time_utc")).alias("last_at"), F.when(trade, F.col("trade_time_utc")).alias("volume_at"), (~trade).alias("book_known"), CAL.trade_date("trade_time_utc").alias("trade_date"),
    )


@query
def latest_quote_stream(spark, sf_dir):
    path_rows = live.upsert_quotes(_stream_quotes(spark, sf_dir))
    return path_rows.select(*_QUOTE_OUT)


@query
def latest_quote_upsert(spark, sf_dir):
    """Two flushes merged: the events before and from the middle of the month."""
    q = samples.quote_events(spark, sf_dir)
    half = ntz("2024-01-16 12:00:00")
    merged = live.merge_quotes(live.latest_quotes(q.where(F.col("received_at") < half)), live.latest_quotes(q.where(F.col("received_at") >= half)))
    return merged.select(*_QUOTE_OUT)


@query
def quote_read(spark, sf_dir):
    q = samples.quote_events(spark, sf_dir)
    fronts = _front(spark, sf_dir)[1].select("instrument", F.col("active").alias("contract_id"))
    last = q.agg(F.max("received_at").alias("t"))
    rows = live.latest_quotes(q).crossJoin(F.broadcast(last))
    out = live.quote_read(rows, fronts, F.col("t"), CAL.trade_date(F.col("t")))
    return out


@query
def stream_footprint(spark, sf_dir):
    cells = live.drain(live.stream_footprint(_stream_trades(spark, sf_dir)), "footprint")
    return live.single_contract_cells(cells).select("instrument", "bucket_start", "price", "buy_volume", "sell_volume")


@query
def late_rows(spark, sf_dir):
    return maintenance.late_rows(samples.trades(spark, sf_dir), samples.export_receipts(spark, sf_dir)).drop("venue")


def _arrivals(spark, sf_dir):
    """Prints as they come: most in ten-day loads, every fiftieth only in the last one."""
    at = F.col("trade_time_utc")
    return samples.trades(spark, sf_dir).drop("recorded_at").withColumn("load", F.when(F.col("sequence") % 50 == 0, 2).otherwise(F.least(F.floor((F.dayofmonth(at) - 1) / 10), F.lit(2))))


@query
def late_rows_stream(spark, sf_dir):
    """A stream that is started anew for each load that has come."""
    source, out = scratch(spark, "arrivals"), scratch(spark, "days")
    rows = _arrivals(spark, sf_dir)
    for load in range(3):
        part = rows.where(F.col("load") == load).drop("load")
        part.write.parquet(f"{source}/load{load}")
        stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", True).parquet(source)
        _, late = live.stream_days(stream, out)
    return live.days_to_export(late).drop("venue")


@query
def recorder_health(spark, sf_dir):
    now = ntz("2024-01-24 18:00:00")
    ticks = tape.last_tick(samples.trades(spark, sf_dir), ntz("2024-01-20"), now).drop("prints")
    es = F.col("instrument") == "ES"
    lease = samples.trades(spark, sf_dir).select("venue", "instrument").distinct().select(
        "venue", "instrument", (now - F.make_dt_interval(secs=F.lit(20))).alias("heartbeat_at"), F.when(es, now + F.make_dt_interval(mins=F.lit(1))).otherwise(now - F.make_dt_interval(mins=F.lit(1))).alias("expires_at"),
        F.lit(True).alias("hub_connected"), F.lit(True).alias("listening"),
    )
    running = calendars.product_sessions(_dates(spark, sf_dir), CAL).where((F.col("open_utc") <= now) & (F.col("close_utc") > now))
    session = lease.select("venue", "instrument").crossJoin(F.broadcast(running.select(F.col("open_utc").alias("window_start"), F.col("close_utc").alias("window_end"))))
    return live.recorder_health(ticks, samples.tape_coverage(spark, sf_dir), lease, session, now).drop("venue")




# --- snapshots ----------------------------------------------------------------------------------------------------------


def _snapshot(spark, sf_dir):
    both = reduce(DataFrame.unionByName, [samples.bars(spark, sf_dir, minutes) for minutes in snapshot.RESOLUTIONS])
    window = intervals.covered_window(samples.tape_coverage(spark, sf_dir), ntz("2024-01-24"), ntz("2024-02-01"))
    return snapshot.Snapshot(both, indicators.catalogue(both, CAL), _dates(spark, sf_dir), CAL, ntz(AS_OF), window, *_profile(spark, sf_dir), _WEIGHTED)


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@query
def snapshot_series(spark, sf_dir):
    """Per instrument and bar size: session, newest bar, the windows of bars that are shown and that levels look at, and how many bars levels come from."""
    rows = _snapshot(spark, sf_dir).state()
    return rows.select(
        "instrument", *_long("resolution_minutes"), "is_open", "trade_date", "next_open_utc", "close", "volume", "bars", "first_bucket", "last_bucket", "contracts", "span",
        "level_bars", "level_first_bucket", "level_contracts", "level_span", "detected_over_bars",
    )


@query
def snapshot_bars(spark, sf_dir):
    return _snapshot(spark, sf_dir).shown().select(*_long("resolution_minutes"), *BAR)


@query
def snapshot_readings(spark, sf_dir):
    return _snapshot(spark, sf_dir).readings().select("instrument", *_long("resolution_minutes", "period"), "indicator", F.round("value", 6).alias("value"), "bucket_start", "contract_id")


@query
def snapshot_levels(spark, sf_dir):
    """The zones of each series from low to high, without what is refused."""
    z = _snapshot(spark, sf_dir).levels()
    return z.select("instrument", *_long("resolution_minutes"), "position", "method", "kind", *[F.round(c, 6).alias(c) for c in ("bottom", "top", "significance")], "touches")


@query
def snapshot_methods(spark, sf_dir):
    return _snapshot(spark, sf_dir).methods().select("instrument", *_long("resolution_minutes"), "method", "family", "weight", "zones", "capped", "absence")
