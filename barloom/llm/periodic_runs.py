"""Periodic runs of words, by branching tandem repeats on an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import SPACED, Words, mix, range_hash, text_buffer, text_slices

#: A run is at least so many words long, and at least so many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Suffixes that are tested at once; more are tested in turn.
TESTED = 1 << 20


def _stretches(h: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words outside which no run can lie; `part` numbers what a run may not cross.

    Of a run of n >= max(least, 3 q) words with period q, every gram of
    least / 3 + 1 words comes again q words later or earlier, so the starts of
    grams that their part holds twice cover it without a break.
    """
    size = least // LEAST_TIMES + 1
    at = np.arange(max(len(h) - size + 1, 0))
    at = at[part[at] == part[at + size - 1]] if len(at) else at
    gram = mix(range_hash(h, at, at + size) + part[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(len(h) + 2, np.int8)
    twice[1 + at[order[1:][same]]] = 1
    twice[1 + at[order[:-1][same]]] = 1
    edge = np.diff(twice)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = ends + size - 1  # a part ends with words that start no gram, so no stretch goes on in the next part
    long = ends - starts >= least
    return starts[long], ends[long]


def _gather(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the number of the range of each."""
    sizes = ends - starts
    part = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(int(sizes.sum())) - (np.cumsum(sizes) - sizes)[part] + starts[part], part


class SuffixArray:
    """Suffixes of words, sorted, with inverse and longest common prefixes; a suffix ends with its part.

    Ranks double their depth round by round, for those suffixes alone that are
    not told apart yet; the ranks of all rounds give the common prefixes.
    """

    def __init__(self, words: np.ndarray, part: np.ndarray):
        n = len(words)
        key = part.astype(np.int64) * (int(words.max()) + 1) + words
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        levels, depth = [rank], 1
        count = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(count[rank] > 1)
        while len(open_):
            beyond = open_ + depth
            ok = beyond < n
            second = np.full(len(open_), -1, np.int64)
            second[ok] = np.where(part[beyond[ok]] == part[open_[ok]], rank[beyond[ok]], -1)
            old = rank[open_].astype(np.int64)
            key = old * (n + 1) + second + 1
            order = np.argsort(key, kind="stable")
            key, old = key[order], old[order]
            at = np.arange(len(order))
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
            inner = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
            rank = rank.copy()
            rank[open_[order]] = old + inner - group
            single = np.concatenate([key[1:] != key[:-1], [True]]) & (inner == at)
            open_ = np.sort(open_[order[~single]])
            levels.append(rank)
            depth *= 2
        self.rank = rank
        self.suffix = np.empty(n, np.int64)
        self.suffix[rank] = np.arange(n)
        # lcp[j] is what suffixes j - 1 and j share; the borders are below all
        self.lcp = np.full(n + 1, -1, np.int64)
        a, b, common = self.suffix[:-1], self.suffix[1:], np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            inside = (x < n) & (y < n)
            alike = np.zeros(n - 1, bool)
            alike[inside] = levels[k][x[inside]] == levels[k][y[inside]]
            common[alike] += 1 << k
        self.lcp[1:n] = common

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place j with a common prefix: j itself, and the first place and the end of the interval of that depth around it."""
        lcp = self.lcp.tolist()
        n = len(lcp) - 1
        left, right, stack = [0] * (n + 1), [0] * (n + 1), [0]
        for j in range(1, n + 1):
            v = lcp[j]
            while lcp[stack[-1]] > v:
                right[stack.pop()] = j
            top = stack[-1]
            left[j] = left[top] if lcp[top] == v else top
            stack.append(j)
        at = np.flatnonzero(self.lcp > 0)
        return at, np.array(left, np.int64)[at], np.array(right, np.int64)[at]


def branching_tandems(array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each square whose halves share exactly one half's length.

    An interval of depth d holds the suffixes with a common prefix of d words, its
    children those that share more. For all children but the largest, each suffix
    i is tested by the inverse: if i + d or i - d lies in the interval and in
    another child, the earlier of the two starts a square that does not go on.
    """
    at, left, right = array.intervals()
    depth = array.lcp[at]
    order = np.lexsort((at, depth, left))
    at, left, right, depth = at[order], left[order], right[order], depth[order]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])])
    head = np.flatnonzero(new)
    # an interval's children: from its first place to the first border, between borders, and from the last border on
    interval = np.concatenate([np.arange(len(head)), np.cumsum(new) - 1])
    begin = np.concatenate([left[head], at])
    follows = np.concatenate([at[1:], [0]])
    last = np.concatenate([new[1:], [True]])
    end = np.concatenate([at[head], np.where(last, right, follows)])
    order = np.lexsort((begin, interval))
    interval, begin, end = interval[order], begin[order], end[order]
    size = end - begin
    firsts = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    largest = np.maximum.reduceat(size, firsts)[interval] == size
    chosen = np.flatnonzero(largest)
    chosen = chosen[np.unique(interval[chosen], return_index=True)[1]]
    small = np.ones(len(size), bool)
    small[chosen] = False
    begin, end, interval = begin[small], end[small], interval[small]
    low, high, deep = left[head][interval], right[head][interval], depth[head][interval]
    done = np.cumsum(end - begin)
    starts, periods, k = [], [], 0
    while k < len(begin):
        stop = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + TESTED, side="right")))
        place, child = _gather(begin[k:stop], end[k:stop])
        child += k
        i, d = array.suffix[place], deep[child]
        for other in (i + d, i - d):
            inside = np.flatnonzero((other >= 0) & (other < len(array.rank)))
            r, c = array.rank[other[inside]], child[inside]
            hit = inside[(r >= low[c]) & (r < high[c]) & ((r < begin[c]) | (r >= end[c]))]
            starts.append(np.minimum(i[hit], other[hit]))
            periods.append(d[hit])
        k = stop
    both = np.unique(np.concatenate(starts) * (len(array.rank) + 1) + np.concatenate(periods))
    return both // (len(array.rank) + 1), both % (len(array.rank) + 1)


def _rotated(words: np.ndarray, start: int, period: int, first: int) -> int:
    """How many words the square at `start` can be rotated to the left, at most to `first`."""
    room, done, block = start - first, 0, 64
    while done < room:
        take = min(block, room - done)
        end = start - done
        differs = np.flatnonzero(words[end - take : end] != words[end - take + period : end + period])
        if len(differs):
            return done + take - 1 - int(differs[-1])
        done += take
        block *= 2
    return room


def runs_of(words: np.ndarray, part: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run inside a part; `words` are numbers, equal for equal words."""
    if not len(words):
        return []
    start, period = branching_tandems(SuffixArray(words, part))
    need = np.maximum(least, LEAST_TIMES * period) - 2 * period
    for step in range(1, LEAST_WORDS):  # most squares cannot be rotated far
        if not len(start):
            return []
        back = start - step
        ok = (need < step) | ((back >= 0) & (words[np.maximum(back, 0)] == words[back + period]) & (part[np.maximum(back, 0)] == part[start]))
        start, period, need = start[ok], period[ok], need[ok]
    first = np.searchsorted(part, part[start], side="left")
    found: dict[tuple[int, int], int] = {}
    for s, q, n, f in zip(start.tolist(), period.tolist(), need.tolist(), first.tolist(), strict=True):
        turned = _rotated(words, s, q, f)
        if turned >= n:
            # a run of period q has squares of its multiples too, and all merge into the same words
            whole = (s - turned, turned + 2 * q)
            found[whole] = min(q, found.get(whole, q))
    return sorted((s, n, q) for (s, n), q in found.items())


def _text_runs(words: Words, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a slice, by word number in the text."""
    counts = np.diff(words.row)
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    h = words.hashes()
    text = np.repeat(np.arange(len(counts)), counts)
    at, part = np.arange(len(h)), text
    # what comes again elsewhere in the text falls away when each stretch is looked at by itself
    for _ in range(3):
        starts, ends = _stretches(h[at], part, least)
        if int((ends - starts).sum()) == len(at):
            break
        place, part = _gather(starts, ends)
        at = at[place]
    if not len(at):
        return out
    numbers: dict[bytes, int] = {}
    raw = words.raw
    spelled = [numbers.setdefault(raw[s:e].tobytes(), len(numbers)) for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
    for start, length, period in runs_of(np.array(spelled, np.int64), part, least):
        first = int(at[start])
        k = int(text[first])
        out[k].append((first - int(words.row[k]), length, period))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    parts = text.split()
    if runs:
        gone = np.zeros(len(parts) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        parts = [parts[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(parts)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(row, n_words, runs, collapsed): row holds all columns of `docs`.

    A run is a longest stretch of words (`[^\\x20\\x09-\\x0D]+`) in which words
    `period` apart are equal, for the smallest such period, of at least `least`
    words and three periods. `runs` are ordered by start and period. In
    `collapsed` only the first period of every run stays, joined by one space
    with the words outside runs; a word that one run drops goes, whatever other
    runs hold it.

    Null and empty texts have no words, no runs and an empty `collapsed`. Rows
    are judged one by one, so repeated rows give equal results, and other columns
    may have any names. An empty table gives an empty result. A text is handled
    whole; a task needs about 40 bytes for each byte of its longest text, and for
    the words that may lie in runs about 300 bytes each, beside four bytes for
    each doubling up to the longest repeat.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "text"):
            raw, offsets = text_buffer(piece.column("text"))
            words = Words(raw, offsets, SPACED)
            found = _text_runs(words, least)
            whole = [_collapsed(raw[a:b].tobytes(), r) for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), found, strict=True)]
            runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], _RUN)
            yield pa.record_batch([piece.column("row"), pa.array(np.diff(words.row).astype(np.int64)), runs, pa.array(whole, pa.binary()).cast(pa.string())], names=["row", "n_words", "runs", "collapsed"])

    runs = ArrayType(StructType.fromDDL("start long, length long, period long"))
    schema = packed.select("row").schema.add("n_words", "long").add("runs", runs).add("collapsed", "string")
    return packed.mapInArrow(run, schema)


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the one that starts first, then the one of the smallest period."""
    size = lambda a, b: a["length"] * b["period"]
    order = lambda a, b: (
        F.when(size(a, b) > size(b, a), -1).when(size(a, b) < size(b, a), 1)
        .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
        .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
    )
    return F.get(F.array_sort(runs, order), F.lit(0))
