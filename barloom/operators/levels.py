"""Support and resistance: swing pivots, prior-period lines, volume levels, zones and their confluence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.market_time import Calendar, let, market_date, plus_minutes
from .frames import CHUNK, chunked, extremes, numbered
from .indicators import heikin_ashi
from .series import RUN, SERIES, over_run, runs_in_blocks, with_runs

KEYS = ["venue", "instrument", "resolution_minutes"]
ZONE = ["bottom", "top", "kind", "formed_at", "touches", "significance", "period"]
#: Fibonacci ratios and Camarilla divisors.
FIBONACCI, CAMARILLA = (0.382, 0.618, 1.0), (12, 6, 4, 2)
FORMULAS = ("classic", "fibonacci", "camarilla", "woodie", "demark")


@dataclass(frozen=True)
class Options:
    left: int = 20
    right: int = 15
    source: str = "HeikinAshiBody"
    atr_multiple: float = 0.5
    min_significance: float = 0.5
    width_percent: float = 2.5
    max_levels: int = 12
    weights: dict[str, float] = field(default_factory=dict)


def pivot_prices(bars: DataFrame, source: str, block_rows: int | None = None) -> DataFrame:
    """Adds run_id, with `block_rows` also block, and p_high and p_low: the prices among which pivots are sought."""
    runs = (lambda b: runs_in_blocks(b, block_rows)) if block_rows else with_runs
    if source == "HighLow":
        return runs(bars).withColumn("p_high", F.col("high")).withColumn("p_low", F.col("low"))
    if source == "Body":
        return runs(bars).withColumn("p_high", F.greatest("open", "close")).withColumn("p_low", F.least("open", "close"))
    if source == "HeikinAshiBody":
        rows = heikin_ashi(bars, block_rows=block_rows)
        if block_rows:  # its run numbers are the same
            rows = runs_in_blocks(rows.drop("run_id"), block_rows)
        return rows.withColumn("p_high", F.round("body_high", 8)).withColumn("p_low", F.round("body_low", 8)).drop("ha_open", "ha_close", "body_high", "body_low")
    raise ValueError(f"unknown pivot source {source}")


def _around_by_chunks(bars: DataFrame, options: Options, block_rows: int) -> DataFrame:
    """Bars with `_high` and `_low`, the extremes around them, by chunks of a run: the cost does not depend on how far is looked."""
    # what a bar sees ahead is the frame that ends so far ahead
    before, after = options.left, options.right
    rows = chunked(numbered(pivot_prices(bars, options.source, block_rows)), before + after, after, block_rows)
    rows = extremes(rows, before, "p_high", "p_low", ("_lh", "_ll"))
    rows = extremes(rows, after, "p_high", "p_low", ("_rh", "_rl"))
    w = Window.partitionBy(*CHUNK).orderBy("_n")
    last = F.lead("_n", after).over(w).isNotNull()  # bars too near the end of their run see no whole frame
    rows = rows.withColumns({"_high": F.greatest(F.lag("_lh").over(w), F.lead("_rh", after).over(w)), "_low": F.least(F.lag("_ll").over(w), F.lead("_rl", after).over(w)), "_whole": last})
    return rows.where(F.col("_own") & F.col("_whole") & (F.col("_n") > before))


def _around(bars: DataFrame, options: Options) -> DataFrame:
    w = over_run()
    around = (w.rowsBetween(-options.left, -1), w.rowsBetween(1, options.right))
    rows = pivot_prices(bars, options.source)
    high = F.greatest(*[F.max("p_high").over(x) for x in around])
    low = F.least(*[F.min("p_low").over(x) for x in around])
    whole = Window.partitionBy(*RUN)
    rows = rows.withColumn("_high", high).withColumn("_low", low).withColumn("_n", F.row_number().over(w)).withColumn("_count", F.count("*").over(whole))
    return rows.where((F.col("_n") > options.left) & (F.col("_n") <= F.col("_count") - options.right))


def swing_pivots(bars: DataFrame, options: Options = Options(), block_rows: int | None = None) -> DataFrame:
    """(run keys, bucket_start, price, kind, prominence): bars strictly above, else strictly below, all around them.

    With `block_rows`, by chunks of a run: for long runs, and for looking far.
    """
    inside = _around_by_chunks(bars, options, block_rows) if block_rows else _around(bars, options)
    is_high, is_low = F.col("p_high") > F.col("_high"), F.col("p_low") < F.col("_low")
    return inside.where(is_high | is_low).select(
        *RUN,
        "bucket_start",
        F.when(is_high, F.col("p_high")).otherwise(F.col("p_low")).alias("price"),
        F.when(is_high, "Resistance").otherwise("Support").alias("kind"),
        F.when(is_high, F.col("p_high") - F.col("_high")).otherwise(F.col("_low") - F.col("p_low")).alias("prominence"),
    )


def zones_from_pivots(pivots: DataFrame, scales: DataFrame, options: Options = Options()) -> DataFrame:
    """Pivots as zones around their price, as wide as the average range at the pivot says; scales: keys, bucket_start, atr."""
    rows = pivots.join(scales.select(*SERIES, "bucket_start", "atr"), [*SERIES, "bucket_start"]).where("atr > 0")
    significance = F.col("prominence") / F.col("atr")
    half = F.col("atr") * options.atr_multiple / 2
    return rows.where(significance >= options.min_significance).select(
        *SERIES, (F.col("price") - half).alias("bottom"), (F.col("price") + half).alias("top"), "kind", F.col("bucket_start").alias("formed_at"), F.lit(1).cast("long").alias("touches"), significance.alias("significance"), F.lit(None).cast("string").alias("period")
    )


def merge_zones(zones: DataFrame, keys: list[str]) -> DataFrame:
    """Chains of overlapping or touching zones as one; kind and period are the strongest member's."""
    w = Window.partitionBy(*keys).orderBy("bottom", "top")
    reach = F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = zones.withColumn("_new", F.when(reach.isNull() | (F.col("bottom") > reach), 1).otherwise(0))
    # equal (bottom, top) rows are peers in order; summing over rows keeps them apart
    rows = rows.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    strongest = F.struct((-F.col("significance")).alias("s"), "formed_at", "bottom", "top", "kind")
    return rows.groupBy(*keys, "_group").agg(
        F.min("bottom").alias("bottom_"),
        F.max("top").alias("top_"),
        F.min_by("kind", strongest).alias("kind_"),
        F.min("formed_at").alias("formed_at_"),
        F.sum("touches").alias("touches_"),
        F.max("significance").alias("significance_"),
        F.min_by(F.struct("period"), strongest).alias("period_"),
    ).select(*keys, F.col("bottom_").alias("bottom"), F.col("top_").alias("top"), F.col("kind_").alias("kind"), F.col("formed_at_").alias("formed_at"), F.col("touches_").alias("touches"), F.col("significance_").alias("significance"), F.col("period_.period").alias("period"))


def width_cap(zones: DataFrame, percent: float) -> DataFrame:
    return zones.where((F.col("top") - F.col("bottom")) * 100 <= percent * (F.col("top") + F.col("bottom")) / 2)


def relabel(zones: DataFrame, closes: DataFrame) -> DataFrame:
    """Zones under the last close support, zones over it resist; closes: keys, last_close."""
    rows = zones.join(closes, KEYS)
    kind = F.when(F.col("top") < F.col("last_close"), "Support").when(F.col("bottom") > F.col("last_close"), "Resistance").otherwise(F.col("kind"))
    return rows.withColumn("kind", kind).drop("last_close")


def level_cap(zones: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("significance"), F.desc("touches"), "bottom", "top", "formed_at", "kind")
    return zones.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def last_closes(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*KEYS).agg(F.max_by("close", "bucket_start").alias("last_close"))


def finish(lines: DataFrame, bars: DataFrame, options: Options, keys: list[str] = KEYS) -> DataFrame:
    """Merge, cap the width, relabel, cap the number: in this order."""
    return level_cap(relabel(width_cap(merge_zones(lines, keys), options.width_percent), last_closes(bars)), keys, options.max_levels)


def levels_swing(bars: DataFrame, scales: DataFrame, options: Options = Options()) -> DataFrame:
    return finish(zones_from_pivots(swing_pivots(bars, options), scales, options), bars, options)


def _dated(bars: DataFrame, scales: DataFrame, calendar: Calendar) -> DataFrame:
    """Bars with trade date and range, and what their series says: first and last bar, current trade date, the periods before it."""
    rows = bars.join(scales.select(*KEYS, "bucket_start", "atr"), [*KEYS, "bucket_start"], "left").withColumn("trade_date", calendar.trade_date("bucket_start"))
    ends = rows.groupBy(*KEYS).agg(
        F.min("bucket_start").alias("_first"),
        F.max("bucket_start").alias("_last"),
        F.max_by("close", "bucket_start").alias("_last_close"),
        F.max_by("trade_date", F.when(F.col("trade_date").isNotNull(), F.col("bucket_start"))).alias("_current"),
    )
    current = F.col("_current")
    week_days = lambda monday: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.date_add(monday, k))
    ends = ends.select(
        "*",
        previous_trading_day(current, calendar).alias("_day"),
        F.date_sub(current, F.weekday(current) + 7).alias("_week"),
        _session_open(previous_trading_day(current, calendar), calendar).alias("_day_open"),
        _session_open(F.array_min(F.filter(week_days(F.date_sub(current, F.weekday(current) + 7)), calendar.is_trading_day)), calendar).alias("_week_open"),
        _session_open(current, calendar).alias("_open"),
    )
    # one row a series: its exchange keeps the day arithmetic out of the bars' plan
    return rows.join(ends, KEYS)


def previous_trading_day(day: Column, calendar: Calendar) -> Column:
    """The nearest trading day in the 14 days before."""
    back = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda k: F.date_sub(day, k))
    return F.array_max(F.filter(back, calendar.is_trading_day))


def _session_open(day: Column, calendar: Calendar) -> Column:
    """The opening of a trade date, NULL if that instant does not belong to it."""
    return let(day, lambda d: let(calendar.session_open(d), lambda o: F.when(calendar.trade_date(o) == d, o)))


def pivot_lines(formula: str) -> Column:
    """The lines of a prior period (columns o, h, l, c): array of (price, kind), kind NULL for the pivot itself."""
    o, h, low, c = (F.col(x) for x in ("o", "h", "l", "c"))
    r, p = h - low, (h + low + c) / 3
    lines: list[tuple[Column, str | None]]
    if formula == "classic":
        lines = [(low - 2 * (h - p), "S"), (p - r, "S"), (2 * p - h, "S"), (p, None), (2 * p - low, "R"), (p + r, "R"), (h + 2 * (p - low), "R")]
    elif formula == "fibonacci":
        lines = [(p, None)] + [(p - f * r, "S") for f in FIBONACCI] + [(p + f * r, "R") for f in FIBONACCI]
    elif formula == "camarilla":
        lines = [(c - 1.1 * r / d, "S") for d in CAMARILLA] + [(c + 1.1 * r / d, "R") for d in CAMARILLA]
    elif formula == "woodie":
        p = (h + low + 2 * c) / 4
        lines = [(p - r, "S"), (2 * p - h, "S"), (p, None), (2 * p - low, "R"), (p + r, "R")]
    elif formula == "demark":
        x = F.when(c < o, h + 2 * low + c).when(c > o, 2 * h + low + c).otherwise(h + low + 2 * c)
        lines = [(x / 2 - h, "S"), (x / 4, None), (x / 2 - low, "R")]
    else:
        raise ValueError(f"unknown pivot formula {formula}")
    names = {"S": "Support", "R": "Resistance", None: None}
    return F.array(*[F.struct(price.alias("price"), F.lit(names[kind]).cast("string").alias("kind")) for price, kind in lines])


def pivot_zones(bars: DataFrame, scales: DataFrame, calendar: Calendar, formulas: tuple[str, ...], options: Options = Options()) -> DataFrame:
    """Lines of the trading day before the current one, for each formula (column method).

    The series has to begin by that day's opening and hold two bars of it.
    """
    rows = _dated(bars, scales, calendar).where("trade_date = _day and _first <= _day_open")
    period = rows.groupBy(*KEYS, "_day", "_last_close").agg(
        F.min_by("open", "bucket_start").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "bucket_start").alias("c"),
        F.max_by(F.struct("atr"), "bucket_start").alias("s"), F.max("bucket_start").alias("formed_at"), F.count("*").alias("n"),
    ).where("n >= 2").withColumn("atr", F.col("s.atr")).where("atr > 0").withColumn("significance", (F.col("h") - F.col("l")) / F.col("atr")).where(F.col("significance") >= options.min_significance)
    sets = F.explode(F.array(*[F.struct(F.lit(f"pivot-{f}").alias("method"), pivot_lines(f).alias("lines")) for f in formulas]))
    lines = period.withColumn("m", sets).withColumn("x", F.explode("m.lines"))
    half = F.col("atr") * options.atr_multiple / 2
    kind = F.coalesce("x.kind", F.when(F.col("x.price") > F.col("_last_close"), "Resistance").otherwise("Support"))
    return lines.select(*KEYS, (F.col("x.price") - half).alias("bottom"), (F.col("x.price") + half).alias("top"), kind.alias("kind"), "formed_at", F.lit(1).cast("long").alias("touches"), "significance", F.col("_day").cast("string").alias("period"), "m.method")


def levels_pivot(bars: DataFrame, scales: DataFrame, calendar: Calendar, formula: str, options: Options = Options()) -> DataFrame:
    return finish(pivot_zones(bars, scales, calendar, (formula,), options).drop("method"), bars, options)


def session_lines(bars: DataFrame, scales: DataFrame, calendar: Calendar, options: Options = Options()) -> DataFrame:
    """The lines of prior day, prior week, overnight and initial balance, each if the series begins by its opening."""
    rows = _dated(bars, scales, calendar)
    current, week = F.col("_current"), F.col("_week")
    today = (F.col("trade_date") == current) & (F.col("_first") <= F.col("_open"))
    balance_end = plus_minutes("_open", 60)
    period = lambda name, with_close: F.struct(name.alias("period"), F.lit(with_close).alias("with_close"))
    member = F.array(
        F.when((F.col("trade_date") == F.col("_day")) & (F.col("_first") <= F.col("_day_open")), period(F.col("_day").cast("string"), True)),
        F.when((F.col("trade_date") >= week) & (F.col("trade_date") <= F.date_add(week, 6)) & (F.col("_first") <= F.col("_week_open")), period(F.concat(F.lit("week:"), week.cast("string")), True)),
        F.when(today & (market_date("_last") >= current) & (market_date("bucket_start") < current), period(F.lit("overnight"), False)),
        F.when(today & (F.col("_last") >= balance_end) & (F.col("resolution_minutes") <= 60) & (F.col("bucket_start") >= F.col("_open")) & (F.col("bucket_start") < balance_end), period(F.lit("initial-balance"), False)),
    )
    rows = rows.withColumn("x", F.explode(F.filter(member, lambda m: m.isNotNull()))).select(*rows.columns, "x.period", "x.with_close")
    # the first bar that reaches an extreme gives the line its time and its scale
    top, low = F.struct(-F.col("high"), F.col("bucket_start")), F.struct(F.col("low"), F.col("bucket_start"))
    bar = F.struct("high", "low", "close", "bucket_start", "atr")
    p = rows.groupBy(*KEYS, "period", "with_close", "_last_close").agg(F.min_by(bar, top).alias("h"), F.min_by(bar, low).alias("l"), F.max_by(bar, "bucket_start").alias("c"))
    span = F.col("h.high") - F.col("l.low")
    line = lambda price, kind, at: F.struct(price.alias("price"), kind.alias("kind"), F.col(f"{at}.bucket_start").alias("at"), F.col(f"{at}.atr").alias("atr"))
    lines = F.array(
        line(F.col("h.high"), F.lit("Resistance"), "h"),
        line(F.col("l.low"), F.lit("Support"), "l"),
        F.when(F.col("with_close"), line(F.col("c.close"), F.when(F.col("c.close") > F.col("_last_close"), "Resistance").otherwise("Support"), "c")),
    )
    out = p.select(*KEYS, "period", span.alias("span"), F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("x")).where("x.atr > 0").withColumn("significance", F.col("span") / F.col("x.atr")).where(F.col("significance") >= options.min_significance)
    half = F.col("x.atr") * options.atr_multiple / 2
    return out.select(*KEYS, (F.col("x.price") - half).alias("bottom"), (F.col("x.price") + half).alias("top"), F.col("x.kind").alias("kind"), F.col("x.at").alias("formed_at"), F.lit(1).cast("long").alias("touches"), "significance", "period")


def levels_session(bars: DataFrame, scales: DataFrame, calendar: Calendar, options: Options = Options()) -> DataFrame:
    return finish(session_lines(bars, scales, calendar, options), bars, options)


VOLUME_KINDS = ("poc", "vah", "val", "traded")
METHODS = ("swing", "session", *[f"pivot-{f}" for f in FORMULAS], *[f"volume-{k}" for k in VOLUME_KINDS])
#: Why a method gives nothing.
NO_LEVELS, NO_TAPE, NARROWED, OVERHANG = "no levels", "no tape", "tape narrowed", "refused: buckets overhang a session close"


def volume_zones(bars: DataFrame, scales: DataFrame, ladder: DataFrame, area: DataFrame, kinds: tuple[str, ...], options: Options = Options()) -> DataFrame:
    """Zones at the point of control (poc), the value area's edges (vah, val) or all other prices (traded); column method.

    ladder: venue, instrument, price, volume; area: venue, instrument, poc, vah,
    val, total_volume, levels. The scale is the newest positive range.
    """
    scale = scales.where("atr > 0").groupBy(*KEYS).agg(F.max_by("atr", "bucket_start").alias("atr"), F.max("bucket_start").alias("formed_at"))
    price = F.col("price")
    is_kind = {k: price == F.col(k) for k in ("poc", "vah", "val")}
    is_kind["traded"] = ~(is_kind["poc"] | is_kind["vah"] | is_kind["val"])
    seeds = {"vah": "Resistance", "val": "Support"}
    found = [F.when(is_kind[k], F.struct(F.lit(f"volume-{k}").alias("method"), F.lit(seeds.get(k, "Unknown")).alias("kind"), F.lit(None if k == "traded" else k).cast("string").alias("period"))) for k in kinds]
    rows = ladder.join(area, ["venue", "instrument"]).join(scale, ["venue", "instrument"]).withColumn("m", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())))
    significance = F.when(F.col("total_volume") == 0, 0.0).otherwise(F.col("volume") * F.col("levels") / F.col("total_volume"))
    half = F.col("atr") * options.atr_multiple / 2
    rows = rows.withColumn("significance", significance).where(F.col("significance") >= options.min_significance)
    return rows.select(*KEYS, (price - half).alias("bottom"), (price + half).alias("top"), "m.kind", "formed_at", F.lit(1).cast("long").alias("touches"), "significance", "m.period", "m.method")


def levels_volume(bars: DataFrame, scales: DataFrame, ladder: DataFrame, area: DataFrame, kind: str, options: Options = Options()) -> DataFrame:
    return finish(volume_zones(bars, scales, ladder, area, (kind,), options).drop("method"), bars, options)


LevelMethod = Callable[[DataFrame, DataFrame, Options], DataFrame]


def level_set(bars: DataFrame, scales: DataFrame, calendar: Calendar, ladder: DataFrame, area: DataFrame, options: Options = Options(), extra: dict[str, LevelMethod] | None = None) -> DataFrame:
    """Zones of all methods, with columns method and family: the lines of all are merged and capped together, method by method.

    `extra` adds a caller's own methods by name: functions of bars, scales and
    options that give lines (keys and the columns of ZONE). The part of a name
    before its first hyphen is its family.
    """
    lines = zones_from_pivots(swing_pivots(bars, options), scales, options).withColumn("method", F.lit("swing"))
    lines = lines.unionByName(session_lines(bars, scales, calendar, options).withColumn("method", F.lit("session")))
    lines = lines.unionByName(pivot_zones(bars, scales, calendar, FORMULAS, options))
    lines = lines.unionByName(volume_zones(bars, scales, ladder, area, VOLUME_KINDS, options))
    for name, make in (extra or {}).items():
        lines = lines.unionByName(make(bars, scales, options).select(*KEYS, *ZONE, F.lit(name).alias("method")))
    zones = finish(lines, bars, options, [*KEYS, "method"])
    return zones.withColumn("family", F.element_at(F.split("method", "-"), 1))


def _family(method: str) -> str:
    return method.split("-")[0]


def refusals(overhang: DataFrame, tape: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(keys, method, reason) of the methods that a series cannot use.

    overhang: keys, overhangs, a row for each series; lines of sessions and prior
    periods are refused where it holds, as their last bucket holds trades of
    the time after. tape: venue, instrument, narrowed, the window of tape that
    the profile is made from; without a row there is none, and a narrowed one
    would pass off a part's profile as the whole window's.
    """
    series = overhang.join(tape.select("venue", "instrument", "narrowed"), ["venue", "instrument"], "left")
    volume = F.when(F.col("narrowed").isNull(), NO_TAPE).when(F.col("narrowed"), NARROWED)
    anchored = F.when(F.col("overhangs"), OVERHANG)
    reasons = {"volume": volume, "session": anchored, "pivot": anchored}
    asked = [F.struct(F.lit(m).alias("method"), reasons[_family(m)].alias("reason")) for m in methods if _family(m) in reasons]
    if not asked:
        return series.select(*KEYS, F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("reason")).where("method is not null")
    return series.select(*KEYS, F.explode(F.array(*asked)).alias("x")).select(*KEYS, "x.*").where("reason is not null")


def allowed(zones: DataFrame, refused: DataFrame) -> DataFrame:
    """Zones of the methods that their series may use: what a level set reports and a confluence scores."""
    return zones.join(refused, [*KEYS, "method"], "left_anti")


def in_order(zones: DataFrame) -> DataFrame:
    """Adds the midpoint of each zone and its position in its series: by midpoint, then bottom, then method."""
    rows = zones.withColumn("midpoint", (F.col("bottom") + F.col("top")) / 2)
    # a series has at most max_levels zones a method
    order = Window.partitionBy(*KEYS).orderBy(F.round("midpoint", 8), F.round("bottom", 8), "method")
    return rows.withColumn("position", F.row_number().over(order).cast("long"))


def method_report(bars: DataFrame, zones: DataFrame, refused: DataFrame, methods: tuple[str, ...] = METHODS, options: Options = Options()) -> DataFrame:
    """What each requested method gave to each series: keys, method, family, weight, zones, capped, absence.

    `zones` are those of a level set; those of refused methods do not count.
    `absence` is the reason of a method without zones: its refusal, else that
    there are no levels. `capped`: it has as many zones as are kept at most, so
    there may have been more. A series without bars has no rows.
    """
    weights = {k.lower(): float(v) for k, v in options.weights.items()}
    asked = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(_family(m)).alias("family"), F.lit(weights.get(m.lower(), 1.0)).alias("weight")) for m in methods]))
    rows = bars.select(*KEYS).distinct().select(*KEYS, asked.alias("m")).select(*KEYS, "m.*")
    counts = allowed(zones, refused).groupBy(*KEYS, "method").agg(F.count("*").alias("zones"))
    rows = rows.join(counts, [*KEYS, "method"], "left").join(refused, [*KEYS, "method"], "left").withColumn("zones", F.coalesce("zones", F.lit(0).cast("long")))
    absence = F.coalesce("reason", F.when(F.col("zones") == 0, NO_LEVELS))
    return rows.select(*KEYS, "method", "family", "weight", "zones", (F.col("zones") == options.max_levels).alias("capped"), absence.alias("absence"))


def confluence(zones: DataFrame, weights: dict[str, float] | None = None, family_discount: bool = True) -> DataFrame:
    """Best score of the clusters of overlapping zones (columns method, family): families add up, methods of one count by their heaviest."""
    w = Window.partitionBy(*KEYS).orderBy("bottom", "top")
    reach = F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = zones.withColumn("_new", F.when(reach.isNull() | (F.col("bottom") > reach), 1).otherwise(0)).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.lower("method") == name.lower(), float(value)).otherwise(weight)
    methods = rows.select(*KEYS, "cluster", "family", "method").distinct().withColumn("weight", weight)
    budget = F.max("weight") if family_discount else F.sum("weight")
    families = methods.groupBy(*KEYS, "cluster", "family").agg(budget.alias("weight"), F.count("*").alias("methods"))
    clusters = families.groupBy(*KEYS, "cluster").agg(F.sum("weight").alias("score"), F.sum("methods").alias("methods"))
    best = Window.partitionBy(*KEYS).orderBy(F.desc("score"), "cluster")
    return clusters.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(*KEYS, "score", "methods")
