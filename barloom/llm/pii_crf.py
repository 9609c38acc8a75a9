"""Personal data: rules for e-mail, IP, card and phone, and a skip-chain CRF that keeps a document's labels consistent."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside; 2 k + 1 begins an entity of kind k, and 2 k + 2 goes on with it.
LABELS = ("O", *(f"{at}-{kind}" for kind in KINDS for at in "BI"))
#: Documents that the potentials are learned from, and different tokens (features, neighbours' labels, label) of theirs, at most.
TRAIN_DOCS, TRAIN_TOKENS = 4000, 40_000
#: Tokens further apart than this many characters are not neighbours in the chain.
CHAIN_GAP = 3
SWEEPS, DAMPING, SURE = 12, 0.3, 0.9

# Fixed patterns of the four rules.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Inside a run of digits no later start can match where the first did not, so each run is tried once, without going back.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_OCTET = re.compile(r"[0-9]{1,3}")  # other digits than these, and long runs, are no part of an address
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HINT = re.compile("[0-9@]")
#: What ends a chunk. Chunks with a digit or an at sign are cut in tokens: runs of digits, runs of letters, single signs.
_END = re.compile(r"[\s<>\"'(),;|\[\]{}]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: around each at sign, the run before it that no earlier match holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.fullmatch(text[start - 1]):
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, in order; failing matches are dropped and not tried again."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in _octets(m[0]))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _octets(text: str) -> list[str]:
    return [p.lstrip("0") or "0" for p in text.split(".")]


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- tokens and features ------------------------------------------------------------------------------------------------

# Fixed lists of what the features tell apart: lengths from each bound on, signs, and characters beside a token.
_LENGTHS = (1, 2, 3, 4, 5, 8, 14, 20)
_SIGNS = ".@-+_/:=%#"
_BESIDE = " .@-+(),:/=_\n"
#: Feature slots of a token: kind of token, length, sign, before, after, case; each slot has its own values.
_SIZES = (3, 3 * len(_LENGTHS), len(_SIGNS) + 2, len(_BESIDE) + 4, len(_BESIDE) + 4, 3)
_STARTS = tuple(sum(_SIZES[:k]) for k in range(len(_SIZES)))
FEATURES = sum(_SIZES)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the tokens of all chunks that hold a digit or an at sign; labels are those of the rules' spans."""
    out, b, done = [], 0, 0
    hint = _HINT.search(text)
    while hint:
        start = hint.start()
        while start > done and not _END.match(text[start - 1]):
            start -= 1
        end = _END.search(text, hint.end())
        done = end.start() if end else len(text)
        for m in _TOKEN.finditer(text, start, done):
            while b < len(base) and base[b][2] <= m.start():
                b += 1
            inside = b < len(base) and base[b][0] < m.end()
            begins = inside and not (out and out[-1][2] and out[-1][0] >= base[b][0])
            out.append((m.start(), m.end(), 2 * base[b][1] + 2 - begins if inside else 0))
        hint = _HINT.search(text, done)
    return out


def _beside(c: str) -> int:
    if c in _BESIDE and c:
        return _BESIDE.index(c)
    return len(_BESIDE) + (3 if not c or c.isspace() else 0 if c.isdigit() else 1 if c.isalpha() else 2)


def features(text: str, start: int, end: int) -> list[int]:
    """One feature of each slot, as a row number. They show shape and surroundings alone; none checks what a rule checks."""
    c = text[start]
    kind = 0 if "0" <= c <= "9" else 1 if c.isalpha() else 2
    size = sum(end - start >= n for n in _LENGTHS) - 1
    sign = _SIGNS.find(c) + 1 if kind == 2 else len(_SIGNS) + 1
    case = 0 if kind != 1 else 1 + text[start:end].islower()
    values = (kind, kind * len(_LENGTHS) + size, sign, _beside(text[start - 1 : start]), _beside(text[end : end + 1]), case)
    return [s + v for s, v in zip(_STARTS, values, strict=True)]


def likeness(text: str) -> str | None:
    """Tokens with the same likeness are tied: case aside, at least three digits or four letters."""
    return text.lower() if len(text) >= (3 if "0" <= text[0] <= "9" else 4) else None


@dataclass(frozen=True)
class Potentials:
    """Log potentials: features by label, label by label for neighbours (the last row: no neighbour before), and for repeats."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


NONE = len(LABELS)


class Graph:
    """The tokens of many documents as one factor graph; documents do not touch."""

    def __init__(self) -> None:
        self.features: list[list[int]] = []
        self.label: list[int] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, text: str, found: list[tuple[int, int, int]]) -> None:
        last: dict[str, int] = {}
        previous = None
        for start, end, label in found:
            node = len(self.features)
            self.features.append(features(text, start, end))
            self.label.append(label)
            if previous is not None and start - previous <= CHAIN_GAP:
                self.chain.append((node - 1, node))
            previous = end
            # each token is tied to its last repeat, so ties grow with the tokens and not with their pairs
            key = likeness(text[start:end])
            if key is not None:
                if key in last:
                    self.skip.append((last[key], node))
                last[key] = node

    def own(self, p: Potentials) -> np.ndarray:
        """Each token's log potential: its features, and what it is worth to have no neighbour before; a rule's label is certain."""
        own = p.unary[np.array(self.features, np.int64).reshape(-1, len(_SIZES))].sum(axis=1)
        first = np.ones(len(own), bool)
        first[[b for _, b in self.chain]] = False
        own[first] += p.chain[NONE]
        label = np.array(self.label, np.int64)
        sure = np.flatnonzero(label)
        own[sure] = -50.0
        own[sure, label[sure]] = 0.0
        return own

    def marginals(self, p: Potentials) -> np.ndarray:
        """Loopy sum-product, all edges at once, damped; a fixed number of sweeps, so a document's result is its own."""
        own = self.own(p)
        if not len(own) or not self.chain and not self.skip:
            return _softmax(own)
        edges = np.array(self.chain + self.skip, np.int64).reshape(-1, 2)
        n, chains = len(edges), len(self.chain)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(n) + n, np.arange(n)])
        kinds = [(slice(0, chains), p.chain[:NONE]), (slice(chains, n), p.skip), (slice(n, n + chains), p.chain[:NONE].T), (slice(n + chains, 2 * n), p.skip.T)]
        message = np.zeros((2 * n, NONE))
        for _ in range(SWEEPS):
            belief = own.copy()
            np.add.at(belief, target, message)
            cavity = belief[source] - message[back]
            cavity = np.exp(cavity - cavity.max(axis=1, keepdims=True))
            new = np.concatenate([cavity[where] @ np.exp(table) for where, table in kinds])
            new = np.log(new / new.max(axis=1, keepdims=True))
            message = DAMPING * message + (1 - DAMPING) * new
        belief = own.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)

    def situations(self) -> np.ndarray:
        """For each token its features, the labels before, after, of its last and its next repeat (NONE without), and its own."""
        beside = np.full((len(self.label), 4), NONE, np.int64)
        label = np.array(self.label, np.int64)
        for k, edges in ((0, self.chain), (2, self.skip)):
            pairs = np.array(edges, np.int64).reshape(-1, 2)
            beside[pairs[:, 1], k] = label[pairs[:, 0]]
            beside[pairs[:, 0], k + 1] = label[pairs[:, 1]]
        return np.column_stack([np.array(self.features, np.int64).reshape(-1, len(_SIZES)), beside, label])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True)) if len(x) else x
    return e / e.sum(axis=1, keepdims=True) if len(x) else x


def train(docs: DataFrame, text_col: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS, seed: int = 10) -> Potentials:
    """Learn all potentials together by pseudo-likelihood on a bounded sample of whole documents, chosen by a hash, labelled by the rules.

    Each token's label is predicted from its features and its neighbours' and
    repeats' labels; tokens in the same situation are counted on Spark first.
    """
    marked = docs.where(F.col(text_col).rlike("[0-9@]"))
    n = marked.count()
    share = min(1.0, train_docs / n) if n else 0.0
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            graph = Graph()
            for text in part.column("text").to_pylist():
                graph.add(text, tokens(text, base_spans(text)))
            rows, n = np.unique(graph.situations(), axis=0, return_counts=True)
            yield pa.record_batch([pa.array(list(rows), pa.list_(pa.int64())), pa.array(n.astype(np.int64))], names=["x", "n"])

    sample = marked.where(draw < share).select(F.col(text_col).alias("text")).mapInArrow(run, "x array<long>, n long")
    seen = sample.groupBy("x").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "x").limit(TRAIN_TOKENS).collect()
    rows = np.array([r["x"] for r in seen], np.int64).reshape(len(seen), len(_SIZES) + 5)
    return fit(rows, np.array([r["n"] for r in seen], float))


def fit(rows: np.ndarray, n: np.ndarray, steps: int = 300, rate: float = 0.3, decay: float = 1e-5) -> Potentials:
    """Maximise the pseudo-likelihood of situations that came `n` times, by gradient steps scaled by their history (Adam)."""
    size = len(_SIZES)
    x, before, after, last, later, y = rows[:, :size], *rows[:, size:].T
    shapes = {"unary": (FEATURES, NONE), "chain": (NONE + 1, NONE), "skip": (NONE, NONE)}
    p = {k: np.zeros(v) for k, v in shapes.items()}
    if not len(rows):
        return Potentials(**p)
    mean, square = ({k: np.zeros(v) for k, v in shapes.items()} for _ in range(2))
    weight, goal = (np.sqrt(n) / np.sqrt(n).sum())[:, None], np.eye(NONE)[y]
    has = {name: np.flatnonzero(v < NONE) for name, v in (("after", after), ("last", last), ("later", later))}
    for step in range(1, steps + 1):
        score = p["unary"][x].sum(axis=1) + p["chain"][before]
        score[has["after"]] += p["chain"][:NONE].T[after[has["after"]]]
        score[has["last"]] += p["skip"][last[has["last"]]]
        score[has["later"]] += p["skip"].T[later[has["later"]]]
        error = (_softmax(score) - goal) * weight
        slope = {k: decay * v for k, v in p.items()}
        for k in range(size):
            np.add.at(slope["unary"], x[:, k], error)
        np.add.at(slope["chain"], before, error)
        for name, k, v in (("after", "chain", after), ("later", "skip", later)):
            turned = np.zeros((NONE, NONE))
            np.add.at(turned, v[has[name]], error[has[name]])
            slope[k][:NONE] += turned.T
        np.add.at(slope["skip"], last[has["last"]], error[has["last"]])
        for k in p:
            mean[k] = 0.9 * mean[k] + 0.1 * slope[k]
            square[k] = 0.999 * square[k] + 0.001 * slope[k] ** 2
            p[k] = p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8) / (1 + step / 100)
    # repeats have no order: what one tells of the other is told both ways
    return Potentials(p["unary"], p["chain"], (p["skip"] + p["skip"].T) / 2)


def plausible(kind: int, text: str) -> bool:
    """What an added entity has to be in any case: its digits or its at sign. Numbers that only look like a card are left out by their check digit."""
    digits = _digits(text)
    if KINDS[kind] == "email":
        return "@" in text.strip("@")
    if KINDS[kind] == "ip":
        return len(_octets(text)) >= 4 and all(_OCTET.fullmatch(p) and int(p) <= 255 for p in _octets(text))
    if KINDS[kind] == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def entities(text: str, found: list[tuple[int, int, int]], chance: np.ndarray, sure: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the field adds: plausible tokens in a row, each with at least `sure` for the kind, off the rules' spans."""
    out: list[tuple[int, int, int]] = []
    best = chance.argmax(axis=1).tolist()
    k = 0
    while k < len(found):
        label = best[k]
        if not label:
            k += 1
            continue
        kind, start = (label - 1) // 2, k
        k += 1
        while k < len(found) and best[k] == 2 * kind + 2 and found[k][0] - found[k - 1][1] <= CHAIN_GAP:
            k += 1
        whole = text[found[start][0] : found[k - 1][1]]
        if not any(t[2] for t in found[start:k]) and plausible(kind, whole) and chance[start:k, 2 * kind + 1 : 2 * kind + 3].sum(axis=1).min() >= sure:
            out.append((found[start][0], kind, found[k - 1][1]))
    return out


def find(docs: DataFrame, potentials: Potentials, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end), the rules' spans and all spans.

    The rules' spans stay as they are, and their labels are certain in the field,
    which carries them to repeats and neighbours. It adds an entity if each of
    its tokens has at least `sure` for the kind and none lies in a rule's span.
    Null texts are empty; rows are judged one by one, so repeated rows have equal
    spans. Texts are handled whole, in time that grows with their length; a task
    needs about 10 times the bytes of its longest one, and 2 kB a token.
    """
    shared = docs.sparkSession.sparkContext.broadcast(potentials)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def rows(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
        return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans], span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for part in text_slices(batches, "text"):
            graph, base, full, mine = Graph(), [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                found = base_spans(text) if _HINT.search(text) else []
                base.append(found)
                mine.append(tokens(text, found))
                graph.add(text, mine[-1])
            chance, at = graph.marginals(learned), 0
            for text, found, own in zip(part.column("text").to_pylist(), base, mine, strict=True):
                full.append([*found, *entities(text, own, chance[at : at + len(own)], sure)] if own else found)
                at += len(own)
            digests = [hashlib.sha256(spell(x).encode()).hexdigest() for x in base]
            yield pa.record_batch([part.column("doc_id"), rows(base), rows([sorted(x) for x in full]), pa.array(digests), pa.array([spell(sorted(x)) for x in full])], names=["doc_id", "base", "spans", "base_sha256", "spelled"])

    kind = "array<struct<start:long,kind:int,end:long>>"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}, base_sha256 string, spelled string")


def count_of(kind: str, column: str = "base"):
    return F.size(F.filter(column, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
