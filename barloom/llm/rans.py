"""Static range asymmetric numeral system on numpy: many independent lanes coded side by side."""

from __future__ import annotations

import numpy as np

#: Frequencies of a table add up to 2 ** SCALE.
SCALE = 20
_SCALE, _MASK = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
_WORD = np.uint64(32)
_FULL, _ROOM = np.uint64(1 << SCALE), np.uint64(64 - SCALE)
_LOW = np.uint64(1 << 32)  # a lane's state stays in [2**32, 2**64)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies with sum 2 ** SCALE; whatever came at all keeps at least 1, so every input can be coded."""
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    if len(seen) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} different symbols")
    exact = counts[seen] / counts[seen].sum() * (1 << SCALE)
    f = np.maximum(np.floor(exact).astype(np.int64), 1)
    rest = (1 << SCALE) - int(f.sum())
    if rest > 0:
        f[np.argmax(f)] += rest
    while rest < 0:  # take what is over from the largest
        for k in np.argsort(-f, kind="stable"):
            take = min(-rest, max(0, int(f[k]) // 2))
            f[k] -= take
            rest += take
            if rest == 0:
                break
    out[seen] = f
    return out


class Table:
    """Frequencies, their running sums and the symbol of each slot."""

    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)
        #: A slot's place within its symbol.
        self.rest = (np.arange(len(self.symbol)) - self.start[self.symbol].astype(np.int64)).astype(np.uint64)
        #: A state from here on has to give up a word first; a symbol that fills the whole table never asks for that.
        self.bound = np.where(self.f < _FULL, self.f << _ROOM, np.uint64((1 << 64) - 1))
        self.f = np.maximum(self.f, np.uint64(1))


def encode(table: Table, lanes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code each row of `lanes` (its first `length` symbols). Gives words (uint32, lane after lane), words per lane, final states."""
    n, steps = lanes.shape
    state = np.full(n, _LOW, np.uint64)
    words = np.zeros((n, steps), np.uint32)
    used = np.zeros(n, np.int64)
    shortest = int(lengths.min(initial=steps))
    columns = np.ascontiguousarray(lanes.T)
    for step in range(steps - 1, -1, -1):
        symbol = columns[step]
        f, bound = table.f[symbol], table.bound[symbol]
        full = step < shortest
        over = np.flatnonzero(state >= bound) if full else np.flatnonzero((lengths > step) & (state >= bound))
        if len(over):
            used[over] += 1
            words[over, steps - used[over]] = state[over].astype(np.uint32)
            state[over] >>= _WORD
        # (q << SCALE) + r + start, with r = state - q * f
        new = state + (state // f) * (_FULL - f) + table.start[symbol]
        state = new if full else np.where(lengths > step, new, state)
    take = np.arange(steps)[None, :] >= (steps - used)[:, None]
    return words[take], used, state


def decode(table: Table, words: np.ndarray, used: np.ndarray, state: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lanes again; cells beyond a lane's length are 0."""
    n, steps = len(lengths), int(lengths.max(initial=0))
    out = np.zeros((steps, n), np.uint32)
    at = np.cumsum(used) - used
    state = state.copy()
    padded = np.concatenate([words, np.zeros(1, np.uint32)])
    shortest = int(lengths.min(initial=0))
    for step in range(steps):
        full = step < shortest
        live = slice(None) if full else np.flatnonzero(lengths > step)
        x = state[live]
        slot = (x & _MASK).astype(np.int64)
        symbol = table.symbol[slot]
        out[step, live] = symbol
        x = table.f[symbol] * (x >> _SCALE) + table.rest[slot]
        low = np.flatnonzero(x < _LOW)
        more = low if full else live[low]
        x[low] = (x[low] << _WORD) | padded[at[more]]
        at[more] += 1
        state[live] = x
    if (state != _LOW).any() or (at != np.cumsum(used)).any():
        raise ValueError("a lane does not end in the state that it began with")
    return np.ascontiguousarray(out.T)
