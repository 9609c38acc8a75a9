"""Technical indicators: one row per bar, NULL until an indicator is warm, restarted at each contract run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.contracts import typical_price
from ..functions.market_time import Calendar
from .frames import framed
from .recurrence import Derive, Smooth, scan, scan_blocks
from .series import BLOCK_ROWS, RUN, SERIES, over_run, rows_before, runs_in_blocks, with_runs

MACD_FAST, MACD_SIGNAL = 12, 9
#: The default catalogue: indicator name and period.
CATALOGUE = [
    ("atr", 14), ("rsi", 14), ("adx", 14), ("plus_di", 14), ("minus_di", 14), ("sma", 20), ("ema", 20), ("macd", 26),
    ("macd_signal", 26), ("macd_histogram", 26), ("vwap", 1), ("bb_middle", 20), ("bb_upper", 20), ("bb_lower", 20), ("vwap_rolling", 20),
]
_FRAMES = ("sma", "bb", "vwap", "vwap_rolling")
_FAMILY = {"bb_middle": "bb", "bb_upper": "bb", "bb_lower": "bb", "macd_signal": "macd", "macd_histogram": "macd", "plus_di": "di", "minus_di": "di", "adx": "di"}


def warmup(name: str, period: int) -> int:
    """Bars that an indicator needs before its first value."""
    if name in ("atr", "rsi", "plus_di", "minus_di"):
        return period + 1
    if name in ("macd_signal", "macd_histogram"):
        return period + MACD_SIGNAL - 1
    return {"adx": 2 * period, "vwap": 1}.get(name, period)


Previous = Callable[[str], Column]


def _lagged(column: str) -> Column:
    return F.lag(column).over(over_run())


def _before(column: str) -> Column:
    return F.col(f"before.{column}")


def _moves(previous: Previous) -> dict[str, Column]:
    """What a bar adds to the one before it; NULL on the first bar of a run."""
    close, high, low = map(previous, ("close", "high", "low"))
    up, down = F.col("high") - high, low - F.col("low")
    known = lambda c: F.when(close.isNotNull(), c)
    return {
        "_tr": known(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close))),
        "_gain": known(F.greatest(F.col("close") - close, F.lit(0.0))),
        "_loss": known(F.greatest(close - F.col("close"), F.lit(0.0))),
        "_plus": known(F.when((up > down) & (up > 0), up).otherwise(0.0)),
        "_minus": known(F.when((down > up) & (down > 0), down).otherwise(0.0)),
    }


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """100 a / b; missing where b is missing or zero."""
    return 100 * np.divide(a, b, out=np.full(len(a), np.nan), where=~np.isnan(b) & (b != 0))


def _strength(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    out = _ratio(gain, gain + loss)
    out[(gain == 0) & (loss == 0)] = 50.0
    return out


def _steps(family: str, n: int) -> tuple[list[Smooth | Derive], set[str]]:
    """The recurrences of a family, and the moves that they need; columns are named `<indicator>_<n>`."""
    if family == "ema":
        return [Smooth(f"ema_{n}", "close", n, 2 / (n + 1))], set()
    if family == "macd":
        if n <= MACD_FAST:
            raise ValueError(f"the slow period must be over {MACD_FAST}")
        return [
            Smooth(f"_fast_{n}", "close", MACD_FAST, 2 / (MACD_FAST + 1)),
            Smooth(f"_slow_{n}", "close", n, 2 / (n + 1)),
            Derive(f"macd_{n}", (f"_fast_{n}", f"_slow_{n}"), np.subtract),
            Smooth(f"macd_signal_{n}", f"macd_{n}", MACD_SIGNAL, 2 / (MACD_SIGNAL + 1)),
            Derive(f"macd_histogram_{n}", (f"macd_{n}", f"macd_signal_{n}"), np.subtract),
        ], set()
    if family == "atr":
        return [Smooth(f"atr_{n}", "_tr", n, 1 / n)], {"_tr"}
    if family == "rsi":
        return [Smooth(f"_g_{n}", "_gain", n, 1 / n), Smooth(f"_l_{n}", "_loss", n, 1 / n), Derive(f"rsi_{n}", (f"_g_{n}", f"_l_{n}"), _strength)], {"_gain", "_loss"}
    return [
        Smooth(f"_t_{n}", "_tr", n, 1 / n),
        Smooth(f"_p_{n}", "_plus", n, 1 / n),
        Smooth(f"_m_{n}", "_minus", n, 1 / n),
        Derive(f"plus_di_{n}", (f"_p_{n}", f"_t_{n}"), _ratio),
        Derive(f"minus_di_{n}", (f"_m_{n}", f"_t_{n}"), _ratio),
        Derive(f"_dx_{n}", (f"plus_di_{n}", f"minus_di_{n}"), lambda p, m: _ratio(np.abs(p - m), p + m)),
        # each stretch of measured values is smoothed for itself
        Smooth(f"adx_{n}", f"_dx_{n}", n, 1 / n, reset=True),
    ], {"_tr", "_plus", "_minus"}


def _framed(family: str, n: int, calendar: Calendar | None) -> dict[str, Column]:
    """Indicators that a frame of rows gives; `_n` numbers the rows of a run."""
    w, warm = rows_before(n), F.col("_n") >= n
    if family == "sma":
        return {f"sma_{n}": F.when(warm, F.avg("close").over(w))}
    if family == "bb":
        mean, deviation = F.avg("close").over(w), F.stddev_pop("close").over(w)
        return {f"bb_middle_{n}": F.when(warm, mean), f"bb_upper_{n}": F.when(warm, mean + 2 * deviation), f"bb_lower_{n}": F.when(warm, mean - 2 * deviation)}
    if family == "vwap_rolling":
        price, volume = F.sum(typical_price() * F.col("volume")).over(w), F.sum("volume").over(w)
        return {f"vwap_rolling_{n}": F.when(warm & (volume > 0), price / volume)}
    assert calendar is not None
    session = Window.partitionBy(*RUN, "trade_date").orderBy("bucket_start").rowsBetween(Window.unboundedPreceding, 0)
    price, volume = F.sum(typical_price() * F.col("volume")).over(session), F.sum("volume").over(session)
    return {f"vwap_{n}": F.when(F.col("trade_date").isNotNull() & (volume > 0), price / volume)}


def wide(bars: DataFrame, families: list[tuple[str, int]], calendar: Calendar | None = None, block_rows: int | None = None) -> DataFrame:
    """Bars with run_id and the columns of all families asked: one exchange by series, its windows, and one pass for all recurrences.

    That suits many series. With `block_rows` recurrences are computed by blocks
    of so many bars and frames by chunks of so many, so that one long series is
    spread over tasks too, and a frame costs the same for any period.
    """
    if block_rows:
        return _in_blocks(bars, families, calendar, block_rows)
    rows = with_runs(bars).withColumn("_n", F.row_number().over(over_run()))
    steps: list[Smooth | Derive] = []
    needs: set[str] = set()
    if any(f == "vwap" for f, _ in families):
        rows = rows.withColumn("trade_date", calendar.trade_date("bucket_start"))
    for family, n in families:
        if family in _FRAMES:
            rows = rows.withColumns(_framed(family, n, calendar))
        else:
            more, moves = _steps(family, n)
            steps += more
            needs |= moves
    if needs:
        made = _moves(_lagged)
        rows = rows.withColumns({k: made[k] for k in sorted(needs)})
    if steps:
        rows = scan(rows, RUN, "bucket_start", steps)
    return rows.drop("_n", *needs, *[s.name for s in steps if s.name.startswith("_")])


def _in_blocks(bars: DataFrame, families: list[tuple[str, int]], calendar: Calendar | None, block_rows: int) -> DataFrame:
    made = [_steps(family, n) for family, n in families if family not in _FRAMES]
    steps, needs = [s for x, _ in made for s in x], set().union(*[x for _, x in made])
    moves = _moves(_before)
    rows = runs_in_blocks(bars, block_rows, ("close", "high", "low"))
    frames = [(family, n) for family, n in families if family in _FRAMES and family != "vwap"]
    if frames:
        rows = framed(rows, frames, block_rows)
    for family, n in families:
        if family == "vwap":  # a run's session is bounded by a day
            rows = rows.withColumn("trade_date", calendar.trade_date("bucket_start")).withColumns(_framed(family, n, calendar))
    rows = rows.withColumns({k: moves[k] for k in sorted(needs)}).drop("before")
    if steps:
        rows = scan_blocks(rows, RUN, "block", "bucket_start", steps)
    return rows.drop("block", *needs, *[s.name for s in steps if s.name.startswith("_")])


def _one(bars: DataFrame, family: str, n: int, columns: dict[str, str], calendar: Calendar | None = None, block_rows: int | None = None) -> DataFrame:
    return wide(bars, [(family, n)], calendar, block_rows).withColumnsRenamed({f"{k}_{n}": v for k, v in columns.items()})


def sma(bars: DataFrame, n: int = 20, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    return _one(bars, "sma", n, {"sma": "value"}, block_rows=block_rows)


def bollinger(bars: DataFrame, n: int = 20, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Columns middle, upper and lower: the mean and two population deviations around it."""
    return _one(bars, "bb", n, {"bb_middle": "middle", "bb_upper": "upper", "bb_lower": "lower"}, block_rows=block_rows)


def ema(bars: DataFrame, n: int = 20, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    return _one(bars, "ema", n, {"ema": "value"}, block_rows=block_rows)


def macd(bars: DataFrame, slow: int = 26, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Columns line, signal and histogram."""
    return _one(bars, "macd", slow, {"macd": "line", "macd_signal": "signal", "macd_histogram": "histogram"}, block_rows=block_rows)


def atr(bars: DataFrame, n: int = 14, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Column value: Wilder's mean of the true range, first at the bar after n changes."""
    return _one(bars, "atr", n, {"atr": "value"}, block_rows=block_rows)


def rsi(bars: DataFrame, n: int = 14, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    return _one(bars, "rsi", n, {"rsi": "value"}, block_rows=block_rows)


def directional(bars: DataFrame, n: int = 14, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Columns plus_di, minus_di and adx; adx starts anew after each bar whose directional index cannot be measured."""
    return _one(bars, "di", n, {"plus_di": "plus_di", "minus_di": "minus_di", "adx": "adx"}, block_rows=block_rows)


def vwap(bars: DataFrame, calendar: Calendar) -> DataFrame:
    """Volume-weighted price since the session's open; NULL outside sessions and while nothing has traded."""
    return _one(bars, "vwap", 1, {"vwap": "value"}, calendar)


def vwap_rolling(bars: DataFrame, n: int = 20, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    return _one(bars, "vwap_rolling", n, {"vwap_rolling": "value"}, block_rows=block_rows)


def heikin_ashi(bars: DataFrame, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Columns ha_open, ha_close, body_high and body_low."""
    mean = lambda at: (at("open") + at("high") + at("low") + at("close")) / 4
    rows = runs_in_blocks(bars, block_rows, ("open", "high", "low", "close")) if block_rows else with_runs(bars)
    # the first value is the middle of the first body, then the mean of the last open and close
    first = F.coalesce(mean(_before if block_rows else _lagged), (F.col("open") + F.col("close")) / 2)
    rows = rows.withColumns({"ha_close": mean(F.col), "_x": first}).drop("before")
    steps = [Smooth("ha_open", "_x", 1, 0.5)]
    rows = scan_blocks(rows, RUN, "block", "bucket_start", steps).drop("block") if block_rows else scan(rows, RUN, "bucket_start", steps)
    return rows.withColumn("body_high", F.greatest("ha_open", "ha_close")).withColumn("body_low", F.least("ha_open", "ha_close")).drop("_x")


Indicator = Callable[[DataFrame, int], DataFrame]


def catalogue(bars: DataFrame, calendar: Calendar, pairs: list[tuple[str, int]] = CATALOGUE, extra: dict[tuple[str, int], Indicator] | None = None) -> DataFrame:
    """Long form: series keys, bucket_start, indicator, period, value; rows without a value are left out.

    `extra` adds a caller's own indicators under their name and period: functions
    of the bars with run_id (an indicator starts anew in each run) and the period
    that give the series keys, bucket_start and value.
    """
    named = [*pairs, *(extra or {})]
    if len(set(named)) != len(named):
        raise ValueError("each indicator and period can be listed once")
    families = list(dict.fromkeys((_FAMILY.get(name, name), n) for name, n in pairs))
    rows = wide(bars, families, calendar)
    values = F.array(*[F.struct(F.lit(name).alias("indicator"), F.lit(n).alias("period"), F.col(f"{name}_{n}").alias("value")) for name, n in pairs])
    made = rows.select(*SERIES, "bucket_start", F.explode(values).alias("v")).select(*SERIES, "bucket_start", "v.indicator", "v.period", "v.value")
    for (name, n), make in (extra or {}).items():
        own = make(with_runs(bars), n).select(*SERIES, "bucket_start", F.lit(name).alias("indicator"), F.lit(n).alias("period"), F.col("value").cast("double").alias("value"))
        made = made.unionByName(own)
    return made.where("value is not null")
