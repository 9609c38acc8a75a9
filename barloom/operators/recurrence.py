"""Smoothing recurrences over sorted series: any number of them in one pass with constant memory."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.storage import stored
from .series import with_columns


@dataclass(frozen=True)
class Smooth:
    """`name` is the mean of the first n values of `x`, then y + alpha * (x - y).

    With `reset`, a missing x drops the state and the next n values in a row seed
    it anew; without, missing values before the seed is full are passed over, and
    the first one after it ends the series: nothing is carried over a hole.
    """

    name: str
    x: str
    n: int
    alpha: float
    reset: bool = False


@dataclass(frozen=True)
class Derive:
    """`name` made from columns that are there already, by a function of arrays."""

    name: str
    of: tuple[str, ...]
    make: Callable[..., np.ndarray]


class _State:
    __slots__ = ("count", "total", "y", "ended")

    def __init__(self) -> None:
        self.count, self.total, self.y, self.ended = 0, 0.0, None, False

    def step(self, x: np.ndarray, n: int, alpha: float) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at = 0
        if self.y is None:
            there = np.flatnonzero(~np.isnan(x))
            need = n - self.count
            if len(there) < need:
                self.count += len(there)
                self.total += float(x[there].sum())
                return out
            at = int(there[need - 1])
            self.y = (self.total + float(x[there[:need]].sum())) / n
            out[at] = self.y
            at += 1
        holes = np.flatnonzero(np.isnan(x[at:]))
        if len(holes) or self.ended:
            self.ended, x = True, x[: 0 if self.ended else at + int(holes[0])]
        if at < len(x):
            # pandas' exponential mean is this recurrence when its first value is the state
            chain = pd.Series(np.concatenate([[self.y], x[at:]])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
            out[at : at + len(chain)] = chain
            self.y = float(chain[-1])
        return out


def _smooth(s: Smooth, x: np.ndarray, states: dict[str, _State]) -> np.ndarray:
    if not s.reset:
        return states.setdefault(s.name, _State()).step(x, s.n, s.alpha)
    out = np.full(len(x), np.nan)
    start = 0
    for gap in [*np.flatnonzero(np.isnan(x)).tolist(), len(x)]:
        if gap > start:
            out[start:gap] = states.setdefault(s.name, _State()).step(x[start:gap], s.n, s.alpha)
        if gap < len(x):
            states.pop(s.name, None)
        start = gap + 1
    return out


def scan(rows: DataFrame, keys: list[str], order: str, steps: list[Smooth | Derive]) -> DataFrame:
    """Add one double column for each step, in order; a step may use the columns of those before it.

    `rows` come from a window over `keys` ordered by `order`, so each series lies
    sorted in one partition. Record batches are walked in turn, and the state of
    the last series is carried into the next batch: memory does not grow with a
    series, and all recurrences share one pass.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        states: dict[str, _State] = {}
        for batch in batches:
            if batch.empty:
                continue
            code = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            cuts = np.flatnonzero(np.diff(code)) + 1
            bounds = [0, *cuts.tolist(), len(batch)]
            key_values = batch[keys]
            columns: dict[str, np.ndarray] = {}

            def column(name: str, batch: pd.DataFrame = batch, columns: dict[str, np.ndarray] = columns) -> np.ndarray:
                if name not in columns:
                    columns[name] = batch[name].to_numpy(float, na_value=np.nan)
                return columns[name]

            # what is carried has to be kept for each step at the start of every series of the batch
            series = [tuple(key_values.iloc[s]) for s in bounds[:-1]]
            held = [states if k == 0 and series[0] == last else {} for k in range(len(series))]
            for step in steps:
                if isinstance(step, Derive):
                    columns[step.name] = step.make(*map(column, step.of))
                else:
                    x = column(step.x)
                    columns[step.name] = np.concatenate([_smooth(step, x[s:e], own) for s, e, own in zip(bounds[:-1], bounds[1:], held, strict=True)])
            last, states = series[-1], held[-1]
            yield batch.assign(**{s.name: columns[s.name] for s in steps})

    schema = rows.schema
    for s in steps:
        schema = schema.add(s.name, "double")
    return rows.sortWithinPartitions(*keys, order).mapInPandas(run, schema)


# --- the same by blocks of a series ---------------------------------------------------------------------------------------


def _depths(steps: list[Smooth | Derive]) -> dict[str, int]:
    """How many recurrences lie one behind the other up to each step's column; a column of the rows has none."""
    out: dict[str, int] = {}
    for s in steps:
        of = (s.x,) if isinstance(s, Smooth) else s.of
        out[s.name] = max(out.get(c, 0) for c in of) + isinstance(s, Smooth)
    return out


@dataclass(frozen=True)
class _Map:
    """What a block makes of the state that comes in: y -> whole * y + rest while it runs, and where its first values may end a seed.

    `first` are the block's first n values; a seed that its value k completes with
    the mean y ends as decay[k] * y + tail[k]. `hole` says that a value is missing,
    and `holes_after[k]` that one is missing after value k. `own` is the state that a
    block with a hole leaves behind where holes reset, whatever comes in.
    """

    rows: int
    values: int
    whole: float
    rest: float
    hole: bool
    first: np.ndarray
    decay: np.ndarray
    tail: np.ndarray
    holes_after: np.ndarray
    own: tuple | None


def _as_tuple(state: _State | None) -> tuple:
    return (state.count, state.total, state.y, state.ended) if state else (0, 0.0, None, False)


def _as_state(held: tuple) -> _State:
    state = _State()
    state.count, state.total, state.y, state.ended = held
    return state


def _map_of(s: Smooth, x: np.ndarray) -> _Map:
    missing = np.isnan(x)
    # with nothing coming in; what stands for missing values does not matter, as no use is made of a chain over a hole
    chain = pd.Series(np.concatenate([[0.0], np.where(missing, 0.0, x)])).ewm(alpha=s.alpha, adjust=False).mean().to_numpy()[1:]
    there = np.flatnonzero(~missing)
    at = there[: s.n]
    decay = (1 - s.alpha) ** (len(x) - 1 - at)
    last_hole = int(np.flatnonzero(missing)[-1]) if missing.any() else -1
    own = None
    if s.reset and last_hole >= 0:
        states: dict[str, _State] = {}
        _smooth(s, x[last_hole:], states)
        own = _as_tuple(states.get(s.name))
    rest = float(chain[-1]) if len(x) else 0.0
    return _Map(len(x), len(there), float((1 - s.alpha) ** len(x)), rest, last_hole >= 0, x[at], decay, rest - decay * chain[at], at < last_hole, own)


def _through(s: Smooth, held: tuple, m: _Map) -> tuple:
    """The state after a block, from the state before it."""
    count, total, y, ended = held
    if m.own is not None:
        return m.own
    if ended or not m.rows:
        return held
    if y is not None:
        return (count, total, 0.0, True) if m.hole else (count, total, m.whole * y + m.rest, False)
    need = s.n - count
    if m.values < need:
        return count + m.values, total + float(m.first.sum()), None, False
    if m.holes_after[need - 1]:
        return count, total, 0.0, True
    return count, total, m.decay[need - 1] * (total + float(m.first[:need].sum())) / s.n + m.tail[need - 1], False


def scan_blocks(rows: DataFrame, keys: list[str], block: str, order: str, steps: list[Smooth | Derive]) -> DataFrame:
    """`scan` by blocks of a series, so that a single long series keeps all tasks busy.

    A recurrence is an affine map of its state, so a block of rows is one too,
    whatever comes in. For each depth of recurrences behind each other, every
    block gives its maps (one row a block), the maps are composed along each
    series, and what comes into each block is joined back to it; the last pass
    scans all blocks with their states. A series meets in one task only as its
    rows of maps: one for each block, with no more numbers than a seed has.

    `block` numbers pieces of each series in its order. The rows are stored once
    and read for each pass; values are those of `scan` up to rounding.
    """
    depth = _depths(steps)
    last = max(depth.values(), default=0)
    base = stored(rows, "blocks")
    place = [*keys, block]

    def walk(level: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        """Scan whole blocks with the states of the recurrences below `level`; give the maps of those of `level`, or the rows if there are none."""

        def of_block(piece: pd.DataFrame) -> pd.DataFrame:
            carry = piece["_carry"].iloc[0] if "_carry" in piece else pickle.dumps({})
            states = {k: _as_state(v) for k, v in pickle.loads(carry).items()}
            columns: dict[str, np.ndarray] = {}

            def column(name: str) -> np.ndarray:
                if name not in columns:
                    columns[name] = piece[name].to_numpy(float, na_value=np.nan)
                return columns[name]

            maps: dict[str, _Map] = {}
            for step in steps:
                if depth[step.name] >= level:
                    if depth[step.name] == level and isinstance(step, Smooth):
                        maps[step.name] = _map_of(step, column(step.x))
                elif isinstance(step, Smooth):
                    columns[step.name] = _smooth(step, column(step.x), states)
                else:
                    columns[step.name] = step.make(*map(column, step.of))
            if level > last:
                return piece.drop(columns="_carry").assign(**{s.name: columns[s.name] for s in steps})
            return piece[place].iloc[:1].assign(maps=[pickle.dumps(maps)], _carry=[carry])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                if batch.empty:
                    continue
                code = batch.groupby(place, sort=False, dropna=False).ngroup().to_numpy()
                bounds = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(batch)]
                for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                    piece = batch.iloc[s:e]
                    # the rows of a block may come in several batches
                    if held and tuple(held[-1][place].iloc[-1]) != tuple(piece[place].iloc[0]):
                        yield of_block(pd.concat(held, ignore_index=True))
                        held = []
                    held.append(piece)
            if held:
                yield of_block(pd.concat(held, ignore_index=True))

        return run

    def compose(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        mine = [s for s in steps if isinstance(s, Smooth) and depth[s.name] == level]

        def run(blocks: pd.DataFrame) -> pd.DataFrame:
            blocks = blocks.sort_values(block, ignore_index=True)
            states = {s.name: _as_tuple(None) for s in mine}
            out = []
            for packed, carry in zip(blocks["maps"], blocks["_carry"], strict=True):
                out.append(pickle.dumps(pickle.loads(carry) | states))
                maps = pickle.loads(packed)
                states = {s.name: _through(s, states[s.name], maps[s.name]) for s in mine}
            return blocks[place].assign(_carry=out)

        return run

    def sorted_blocks(carries: DataFrame | None) -> DataFrame:
        found = base if carries is None else with_columns(base, carries, place)
        return found.repartition(*place).sortWithinPartitions(*place, order)

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in place)
    carries = None
    for level in range(1, last + 1):
        maps = sorted_blocks(carries).mapInPandas(walk(level), f"{named}, maps binary, _carry binary")
        carries = stored(maps.groupBy(*keys).applyInPandas(compose(level), f"{named}, _carry binary"), "carries")
    schema = StructType([*base.schema, *[StructField(s.name, DoubleType()) for s in steps]])
    return sorted_blocks(carries).mapInPandas(walk(last + 1), schema)
