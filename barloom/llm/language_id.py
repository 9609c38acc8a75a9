"""Language identification by prediction by partial matching: per-language byte context trees, frozen."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, text_buffer, text_slices

#: The longest context, in bytes.
ORDER = 3
#: Training texts of a language, and bytes of them, at most about this; with many languages the bytes are fewer, at least LEAST_BYTES.
DOCS_PER_LANGUAGE, BYTES_PER_LANGUAGE, ALL_BYTES, LEAST_BYTES = 3000, 8 << 20, 256 << 20, 1 << 18
#: With fewer texts to be drawn of a language than this, chance might draw none.
RARE = 50
#: Code lengths are kept to 1/1024 bit.
_UNIT = 1024
UNDETERMINED = "und"


class Tree:
    """Frozen counts of one language: every context of up to ORDER bytes of the sample with the bytes that followed it.

    `grams[o]` are the distinct (context of o bytes, byte) as numbers, sorted, and
    `counts[o]` how often each came. A context's node has three sums that a code
    length needs: observations, distinct bytes, and how often the bytes that this
    context has seen came after the context that is one byte shorter.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = [grams.astype(np.int64)], [counts.astype(np.int64)]
        for o in range(ORDER - 1, -1, -1):
            short, inverse = np.unique(self.grams[0] & ((1 << 8 * (o + 1)) - 1), return_inverse=True)
            self.grams.insert(0, short)
            self.counts.insert(0, np.bincount(inverse, weights=self.counts[0], minlength=len(short)).astype(np.int64))
        self.nodes, self.sums = [], []
        for o in range(ORDER + 1):
            node, at = np.unique(self.grams[o] >> 8, return_inverse=True)
            below = self._count(o - 1, self.grams[o] & ((1 << 8 * o) - 1)) if o else np.zeros(len(at), np.int64)
            columns = [np.bincount(at, weights=w, minlength=len(node)) for w in (self.counts[o], np.ones(len(at)), below)]
            self.nodes.append(node)
            self.sums.append(np.stack([*columns], axis=1).astype(np.float64) if len(node) else np.zeros((0, 3)))

    def _count(self, o: int, gram: np.ndarray) -> np.ndarray:
        return _at(self.grams[o], self.counts[o], gram)

    def code_lengths(self, gram: np.ndarray) -> np.ndarray:
        """-log2 P(byte | context) of sorted distinct grams, each a context of ORDER bytes and a byte.

        At a context with n observations of q distinct bytes, a seen byte costs
        count / (n + q) and the escape q / (n + q). After an escape the bytes of
        the longer context are excluded, and a context with no other bytes costs
        nothing. Below the empty context all bytes that are left are alike.
        """
        p, done = np.ones(len(gram)), np.zeros(len(gram), bool)
        distinct = np.zeros(len(gram))
        shared = np.zeros(len(gram))
        for o in range(ORDER, -1, -1):
            live = np.flatnonzero(~done)
            here = gram[live] & ((1 << 8 * (o + 1)) - 1)
            node = _at(self.nodes[o], self.sums[o], here >> 8)
            n, q = node[:, 0] - shared[live], node[:, 1] - distinct[live]
            count = self._count(o, here)
            whole = np.maximum(n + q, 1)
            p[live] *= np.where(count > 0, count / whole, np.where(q > 0, q / whole, 1.0))
            done[live] = count > 0
            shared[live], distinct[live] = node[:, 2], node[:, 1]
        rest = ~done
        p[rest] /= np.maximum(256 - distinct[rest], 1)
        return -np.log2(p)


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, or zeros."""
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit.reshape(-1, *[1] * (values.ndim - 1)), values[at], 0)


@dataclass(frozen=True)
class Model:
    """The languages and their frozen trees."""

    languages: list[str]
    trees: list[Tree]


def _grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte its context of ORDER bytes and itself as one number; a text begins after spaces."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(raw)) + ORDER * (row + 1)
    padded = np.full(len(raw) + ORDER * len(offsets), ord(" "), np.uint32)
    padded[at] = raw
    gram = padded[: len(padded) - ORDER].copy()
    for k in range(1, ORDER + 1):
        gram <<= np.uint32(8)
        gram |= padded[k : len(padded) - ORDER + k]
    return gram[at - ORDER]


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE, bytes_per_language: int = BYTES_PER_LANGUAGE, seed: int = 9) -> Model:
    """Fit on a bounded sample of whole labelled texts of each language, chosen by a hash of the key.

    Only texts and their labels are learned from, and every label is learned:
    where so few texts are drawn that a language may be left with none, its
    first text by the hash is kept too, cut to the bytes of a language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    found = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model([], [])
    most = max(LEAST_BYTES, min(bytes_per_language, ALL_BYTES // len(languages)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, docs_per_language / r["n"], most / max(1, r["bytes"]))) for r in found], "_lang string, _share double")
    # texts count too, so that rows without a key are drawn one by one
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    texts = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"))
    # one row a language
    sample = texts.join(F.broadcast(shares), texts["lang"] == shares["_lang"]).where("draw < _share").select("lang", "text")
    rare = [r["lang"] for r in found if min(docs_per_language, most * r["n"] / max(1, r["bytes"])) < RARE and r["n"]]
    if rare:
        mine = texts.where(F.col("lang").isin(rare))
        low = F.broadcast(mine.groupBy(F.col("lang").alias("_lang")).agg(F.min("draw").alias("_low")))  # one row a language
        first = mine.join(low, (F.col("lang") == F.col("_lang")) & (F.col("draw") == F.col("_low"))).join(F.broadcast(shares), "_lang").where("draw >= _share")
        sample = sample.unionByName(first.select("lang", F.substring("text", 1, most).alias("text")).dropDuplicates(["lang"]))

    def grams_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            labels = np.array(part.column("lang").to_pylist(), object)
            for name in set(labels):
                mine = part.filter(pa.array(labels == name))
                gram, n = np.unique(_grams(*text_buffer(mine.column("text"))), return_counts=True)
                yield pa.record_batch([pa.array([name] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(grams_seen, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    seen = counted.toPandas()
    by_language = dict(iter(seen.sort_values("gram").groupby("lang")))
    none = seen.iloc[:0]
    return Model(languages, [Tree(p["gram"].to_numpy(np.int64), p["n"].to_numpy(np.int64)) for p in (by_language.get(x, none) for x in languages)])


def total_lengths(model: Model, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each whole text under each language. Texts are added up a piece at a time, so only a piece's grams are held."""
    out = np.zeros((len(offsets) - 1, len(model.trees)))
    whole = SLICE_BYTES
    for start in range(0, len(raw), whole):
        end = min(start + whole, len(raw))
        first, last = np.searchsorted(offsets, start, side="right") - 1, np.searchsorted(offsets, end, side="left")
        cuts = np.clip(offsets[first : last + 1], start, end)
        # a text that goes on keeps the bytes before the piece as its context
        back = max(int(offsets[first]), start - ORDER)
        gram = _grams(raw[back:end], np.concatenate([[0], cuts[1:] - back]))[start - back :]
        distinct, place = np.unique(gram, return_inverse=True)
        rows = np.flatnonzero(np.diff(cuts))
        for k, tree in enumerate(model.trees):
            each = np.rint(tree.code_lengths(distinct.astype(np.int64)) * _UNIT)[place]
            out[first + rows, k] += np.add.reduceat(each, cuts[rows] - start) / _UNIT
    return out


def _has_letter(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((raw | 32) >= ord("a")) & ((raw | 32) <= ord("z"))
    running = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = running[offsets[1:]] > running[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(map(str.isalpha, column[int(k)].as_py() or ""))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): row holds all columns of `docs`, lang_pred the language of least code length.

    score is that language's share when each code length L counts as 2 ** -L.
    Ties go to the first language by name. A null text, or one without a
    letter (`str.isalpha`), gives `und` and 0, as does a model without languages.
    Texts are handled whole, a piece at a time: a task needs the bytes of its
    longest one about four times.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        names = np.array([*frozen.languages, UNDETERMINED], object)
        for part in text_slices(batches, "text"):
            column = part.column("text")
            raw, offsets = text_buffer(column)
            best, score = np.full(len(column), len(names) - 1), np.zeros(len(column))
            if frozen.languages:
                bits = total_lengths(frozen, raw, offsets)
                known = _has_letter(column, raw, offsets)
                low = bits.min(axis=1, keepdims=True)
                share = 1 / np.exp2(np.maximum(low - bits, -1000)).sum(axis=1)
                best, score = np.where(known, bits.argmin(axis=1), best), np.where(known, share, 0)
            yield pa.record_batch([part.column("row"), pa.array(names[best], pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    schema = packed.select("row").schema.add("lang_pred", "string").add("score", "double")
    return packed.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """The fifth of the documents that no model is fitted on."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(row, held_out, lang_pred, score) for every document; the model learns from documents that are not held out."""
    model = train(docs.where(~held_out(key)), key=key, **options)
    return predict(docs, model).withColumn("held_out", F.coalesce(held_out(f"row.{key}"), F.lit(False)))
