"""Market snapshots: what there is to know of every series at one moment, at several bar sizes at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.market_time import Calendar
from ..sources.storage import stored
from . import calendars, indicators, levels, series
from .asof import latest_values

KEYS = series.SERIES
RESOLUTIONS = (5, 60)  # the setup and the bias
BARS, LEVEL_BARS = 100, 200  # bars that are shown; levels are found over 200 or over as many as are shown
#: What the contracts of a window of bars say.
SINGLE, ROLL, UNKNOWN = "SingleContract", "SpansRoll", "Unknown"


def window_of(bars: DataFrame, prefix: str = "") -> DataFrame:
    """One row a series: number of bars, first and last bucket, contracts and span. Two known contracts are a roll; else a bar of an unknown one leaves the span unknown."""
    contracts = F.array_sort(F.collect_set("contract_id"))
    span = F.when(F.size(contracts) > 1, ROLL).when(F.bool_or(F.col("contract_id").isNull()), UNKNOWN).otherwise(SINGLE)
    columns = {"bars": F.count("*"), "first_bucket": F.min("bucket_start"), "last_bucket": F.max("bucket_start"), "contracts": F.array_join(contracts, ","), "span": span}
    return bars.groupBy(*KEYS).agg(*[made.alias(prefix + name) for name, made in columns.items()])


def readings(values: DataFrame, bars: DataFrame, pairs: list[tuple[str, int]] = indicators.CATALOGUE) -> DataFrame:
    """The newest value of each indicator up to its series' newest bar, with its own bucket and contract; a row for every pair, so that absent ones show."""
    newest = latest_values(values, bars, F.lit("9999-12-31").cast("timestamp_ntz"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("indicator"), F.lit(p).alias("period")) for n, p in pairs]))
    return bars.select(*KEYS).distinct().select(*KEYS, asked.alias("x")).select(*KEYS, "x.*").join(newest, [*KEYS, "indicator", "period"], "left")


@dataclass
class Snapshot:
    """The snapshot of all series of the bar sizes in `resolutions`: five tables with the keys venue, instrument, resolution_minutes, each made when it is asked for.

    `values` are stored indicator values; `tape` is the window that `ladder` and
    `area` are made from (see `levels.refusals`). Bars after `now` should not be in
    `bars`. Levels look at the newest LEVEL_BARS bars, or at `bar_count` if that is
    more, and come from the newest contract among them. A series without bars has
    no rows.
    """

    bars: DataFrame
    values: DataFrame
    dates: DataFrame
    calendar: Calendar
    now: Column
    tape: DataFrame
    ladder: DataFrame
    area: DataFrame
    options: levels.Options = levels.Options()
    resolutions: tuple[int, ...] = RESOLUTIONS
    bar_count: int = BARS

    def __post_init__(self):
        sizes = self.resolutions
        if self.bar_count < 1 or not sizes or min(sizes) < 1 or len(set(sizes)) < len(sizes):
            raise ValueError("a snapshot takes one bar or more, and each bar size of a minute or more once")
        self.bars = self.bars.where(F.col("resolution_minutes").isin(*sizes))

    @cached_property
    def _looked(self) -> DataFrame:
        return stored(series.latest(self.bars, max(self.bar_count, LEVEL_BARS)), "snapshot-bars")

    @cached_property
    def _scaled(self) -> DataFrame:
        return stored(indicators.atr(series.newest_segment(self._looked).drop("run_id"), block_rows=None), "snapshot-scales")

    @cached_property
    def _zones(self) -> DataFrame:
        scales = self._scaled.select(*KEYS, "bucket_start", F.col("value").alias("atr"))
        return stored(levels.level_set(self._scaled.drop("value", "run_id"), scales, self.calendar, self.ladder, self.area, self.options), "snapshot-levels")

    @cached_property
    def _refused(self) -> DataFrame:
        return levels.refusals(calendars.series_overhangs(self._looked, self.dates, self.calendar, list(self.resolutions)), self.tape)

    def shown(self) -> DataFrame:
        """The newest bars."""
        return series.latest(self._looked, self.bar_count)

    def state(self) -> DataFrame:
        """One row a series: the session at `now`, close and volume of the newest bar, the window that is shown, the one that levels look at, and how many bars they come from."""
        last = self._looked.groupBy(*KEYS).agg(F.max_by(F.struct("close", "volume"), "bucket_start").alias("x")).select(*KEYS, "x.*")
        at = calendars.session_state(last.withColumn("at_utc", self.now), self.dates, self.calendar)
        detected = self._scaled.groupBy(*KEYS).agg(F.count("*").alias("detected_over_bars"))
        return at.join(window_of(self.shown()), KEYS).join(window_of(self._looked, "level_"), KEYS).join(detected, KEYS)

    def readings(self) -> DataFrame:
        return readings(self.values, self.bars)

    def levels(self) -> DataFrame:
        """Zones from low to high, without those of refused methods."""
        return levels.in_order(levels.allowed(self._zones, self._refused))

    def methods(self) -> DataFrame:
        """What each level method gave, or why it gave nothing."""
        return levels.method_report(self._scaled, self._zones, self._refused, options=self.options)
