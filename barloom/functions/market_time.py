"""Market time: UTC instants (timestamp_ntz), Chicago clock, trade dates, bucket grids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/Chicago"
#: Minutes from 0001-01-01, the origin of the bucket grid, to 1970-01-01.
_GRID_ORIGIN_MINUTES = 719_162 * 1440


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_market(instant: Column | str) -> Column:
    """UTC instant as Chicago wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), col(instant))


def from_market(local: Column) -> Column:
    """Chicago wall-clock time as UTC instant; the repeated hour in autumn is read as daylight time."""
    return F.convert_timezone(F.lit(MARKET_ZONE), F.lit("UTC"), local)


def at_minute(day: Column, minutes: Column | int) -> Column:
    """UTC instant of a minute of a Chicago day."""
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return from_market(day.cast("timestamp_ntz") + F.make_dt_interval(mins=m))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, for expressions that name it often. Not compiled: for small tables."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plus_minutes(instant: Column | str, minutes: Column | int) -> Column:
    m = F.lit(minutes) if isinstance(minutes, int) else minutes
    return col(instant) + F.make_dt_interval(mins=m)


def market_date(instant: Column | str) -> Column:
    return F.to_date(to_market(instant))


def market_minute(instant: Column | str) -> Column:
    local = to_market(instant)
    return F.hour(local) * 60 + F.minute(local)


_EPOCH = "1970-01-01 00:00:00"


def epoch_micros(instant: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), col(instant))


def align_down(instant: Column | str, size_minutes: int) -> Column:
    """Start of the bucket that holds the instant, on the UTC grid that begins at 0001-01-01."""
    size = size_minutes * 60_000_000
    offset = (_GRID_ORIGIN_MINUTES % size_minutes) * 60_000_000
    micros = epoch_micros(instant)
    return _from_micros(micros - F.pmod(micros + offset, F.lit(size)))


def align_up(instant: Column | str, size_minutes: int) -> Column:
    size = size_minutes * 60_000_000
    offset = (_GRID_ORIGIN_MINUTES % size_minutes) * 60_000_000
    micros = epoch_micros(instant)
    return _from_micros(micros + F.pmod(-(micros + offset), F.lit(size)))


def _from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit(_EPOCH).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Calendar:
    """Session close and maintenance in Chicago minutes; holidays; early closes by date (minutes)."""

    close: int = 16 * 60
    maintenance: int = 60
    holidays: tuple[str, ...] = ()
    early_closes: dict[str, int] = field(default_factory=dict)

    @property
    def open(self) -> int:
        return self.close + self.maintenance

    def is_trading_day(self, day: Column) -> Column:
        weekday = F.weekday(day) < 5
        return weekday & ~day.cast("string").isin(*self.holidays) if self.holidays else weekday

    def trade_date(self, instant: Column | str) -> Column:
        """Before the close: that day; from the reopening on: the next; NULL in between, and on days without trading."""
        # moved on to midnight, the reopening starts a date; moved from the close, the pause is on the next one already
        local = to_market(instant)
        named = F.to_date(local + F.make_dt_interval(mins=F.lit(1440 - self.open)))
        paused = F.to_date(local + F.make_dt_interval(mins=F.lit(1440 - self.close)))
        return F.when((named == paused) & self.is_trading_day(named), named)

    def ordinary_close(self, day: Column) -> Column:
        return at_minute(day, self.close)

    def session_open(self, day: Column) -> Column:
        return at_minute(F.date_sub(day, 1), self.open)

    def session_close(self, day: Column) -> Column:
        """The close that honours early closes."""
        minute = F.lit(self.close)
        for date, early in self.early_closes.items():
            minute = F.when(day.cast("string") == date, early).otherwise(minute)
        return at_minute(day, minute)

    def is_expected(self, bucket: Column | str, size_minutes: Column | int) -> Column:
        """The bucket opens in a session and ends by its ordinary close."""
        day = self.trade_date(bucket)
        return F.coalesce(day.isNotNull() & (plus_minutes(bucket, size_minutes) <= self.ordinary_close(day)), F.lit(False))


#: The calendar of the test tables: two holidays and one early close.
SAMPLE_CALENDAR = Calendar(holidays=("2024-01-01", "2024-01-15"), early_closes={"2024-01-12": 12 * 60})


def position(received_at: Column, sequence: Column) -> Column:
    """(received_at, sequence) as one number in the same order, NULLs first: numbers are aggregated without sorting rows."""
    whole = lambda c: c.cast("decimal(20,0)")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), received_at)
    instant, place = F.coalesce(whole(micros), whole(F.lit(-(10**18)))), F.coalesce(whole(sequence), whole(F.lit(str(-(1 << 63) - 1))))
    return (instant * whole(F.lit(str(1 << 65))) + place).cast("decimal(38,0)")
