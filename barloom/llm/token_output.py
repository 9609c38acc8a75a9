"""Token ids as binary files: range-coded blocks under one shared frequency table.

File format. A file is a sequence of frames; each frame is a block and one
newline byte (the writer's record separator). Numbers are little-endian.

    magic    8 bytes  b"RANSBLK1"
    header   10 x uint64: length of the block, first position (ids of all
             documents before the block), documents, ids, lanes, words,
             lanes of a segment, file group, documents without an id (the
             block's first ones), crc32 of the ids
    table of documents   doc_id int64 and ids uint64 for each
    checkpoints          for each segment: place of its first word uint64, crc32 of its ids uint64
    lanes                final state uint64 each, then words uint16 each
    words                uint32 each
    crc32 of all above   uint32

Documents are whole inside a block. A block's ids are cut in segments of
LANES * STEPS ids, and each segment is dealt out to LANES interleaved lanes, so
a reader can start at any checkpoint. The shared frequency table is a Parquet
table beside the files (`table/`), the blocks lie in `blocks/`.
"""

from __future__ import annotations

import json
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import materialize, scratch, shuffles_dropped, text_slices

MAGIC = b"RANSBLK1"
LANES, STEPS = 1024, 256
#: A block closes at so many ids; a file has so many blocks at most, about 20 MB unless a document is longer.
BLOCK_IDS, FILE_BLOCKS = 1 << 19, 32
#: Chunks of text whose ids a worker remembers.
MEMORY = 1_200_000

_tokenizers: dict[str, tuple] = {}


def id_type(vocabulary: int) -> str:
    """How ids are held between the steps: 2 bytes if all fit, else 4."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


#: The pre-tokenizer pattern and the normalizers under which a text's ids are those of its white-space separated chunks in turn.
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZERS = {"NFC", "Lowercase", "Replace"}
#: Longer texts are encoded piece by piece, cut at spaces, in characters.
PIECE = 1 << 20


def splits_at_space(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, drops white space and never joins what it separates; others get whole texts."""
    spec = json.loads(tokenizer.to_str())
    normal, split = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal])
    first = split.get("pretokenizers", [split])[0]
    spaces = [x for x in steps if x.get("type") == "Replace"]
    return (
        all(x.get("type") in _NORMALIZERS for x in steps)
        and any(x.get("type") == "Lowercase" for x in steps)
        and all(x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in spaces)
        and first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and first.get("pattern") == {"Regex": _WORD_PATTERN}
        and spec.get("post_processor") is None
    )


def _pieces(text: str) -> Iterator[str]:
    """A long text cut before spaces; a piece without any is left whole."""
    start = 0
    while len(text) - start > PIECE:
        at = text.rfind(" ", start + 1, start + PIECE)
        at = at if at > 0 else text.find(" ", start + PIECE)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)}


class _Chunks(dict):
    """Chunk to ids, as bytes, for tokenizers of the kind that `splits_at_space` lets through; what is not remembered is encoded on the way."""

    def __init__(self, tokenizer, kind: str):
        super().__init__()
        self.whole, self.word, self.characters = tokenizer.encode, tokenizer.model.tokenize, _byte_characters()
        self.letter = {"<u2": "H", "<u4": "I"}[kind]

    def __missing__(self, chunk: str) -> bytes:
        # letters never share a token with the signs after them, and a run of letters is one word of the model
        core = chunk.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or max(core) < _LATIN_END):
            out = self.get(core)
            if out is None:
                word = core if core.isascii() else core.encode().decode("latin-1").translate(self.characters)
                out = self[core] = array(self.letter, [t.id for t in self.word(word)]).tobytes()
            if len(core) < len(chunk):
                out += self[chunk[len(core) :]]
        else:
            out = array(self.letter, self.whole(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = out
        return out


_LATIN_END = "\u0250"


class ChunkEncoder:
    """Encodes texts with the tokenizer, remembering the ids of their white-space separated chunks where that is the same.

    Plain Latin texts are lowered first, so that their chunks are met more
    often. Texts with other characters, odd spaces, or what might be a special
    token go to the tokenizer whole, as do all texts of a tokenizer for which
    `splits_at_space` does not hold.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.by_chunk = splits_at_space(self.tokenizer)
        self.known = _Chunks(self.tokenizer, self.kind)
        self.odd = re.compile("<\\||[\x1c-\x1f]")
        self.other = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f]|<\\|")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _encode(self, text: str) -> bytes:
        if (self.odd if text.isascii() else self.other).search(text):
            return self._whole(text)
        if len(self.known) > MEMORY:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        if not self.by_chunk:
            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return [self._encode(t) if len(t) <= PIECE else b"".join(map(self._encode, _pieces(t))) for t in texts]


def vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


IDS = "doc_id long, n long, ids binary, seen binary"


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids, seen): the ids of each whole text and the end id, n in number, as bytes of `id_type`. Null texts are empty.

    Each task ends with one row more, in which only `seen` is filled: the
    different ids that it wrote and how often, so that nothing has to be read
    again for the shared table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _tokenizers:
            _tokenizers[tokenizer] = ChunkEncoder(tokenizer)
        encoder = _tokenizers[tokenizer]
        end = np.array([end_id], encoder.kind).tobytes()
        total = np.zeros(max(encoder.tokenizer.get_vocab_size(), end_id + 1), np.int64)

        def rows(doc: pa.Array, n: np.ndarray, ids: list, seen: list) -> pa.RecordBatch:
            return pa.record_batch([doc, pa.array(n), pa.array(ids, pa.binary()), pa.array(seen, pa.binary())], names=["doc_id", "n", "ids", "seen"])

        for part in text_slices(batches, "text"):
            ids = [x + end for x in encoder.encode([t or "" for t in part.column("text").to_pylist()])]
            for x in ids if max(map(len, ids)) > PIECE else (b"".join(ids),):
                total += np.bincount(np.frombuffer(x, encoder.kind), minlength=len(total))
            yield rows(part.column("doc_id"), np.array([len(x) // len(end) for x in ids], np.int64), ids, [None] * len(ids))
        used = np.flatnonzero(total)
        if len(used):
            yield rows(pa.nulls(1, pa.int64()), np.zeros(1, np.int64), [None], [np.stack([used, total[used]]).tobytes()])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, IDS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("seen"):
            used, n = np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1)
            yield pa.record_batch([pa.array(used), pa.array(n)], names=["id", "n"])


def _lengths(n_ids: int) -> np.ndarray:
    """Ids of each lane: lane j of a segment takes the segment's ids j, j + LANES, ..."""
    size = LANES * STEPS
    held = np.clip(n_ids - np.arange(-(-n_ids // size)) * size, 0, size)
    return np.clip(-(-(held[:, None] - np.arange(LANES)[None, :]) // LANES), 0, STEPS).reshape(-1)


def pack(first: int, group: int, docs: list[int | None], parts: list[np.ndarray], table: rans.Table) -> bytes:
    ids = np.concatenate(parts).astype("<u4")
    raw = ids.tobytes()
    size = LANES * STEPS
    segments = -(-len(ids) // size)
    grid = np.zeros(segments * size, np.uint32)
    grid[: len(ids)] = ids
    lanes = grid.reshape(segments, STEPS, LANES).transpose(0, 2, 1).reshape(-1, STEPS)
    words, used, state = rans.encode(table, lanes, _lengths(len(ids)))
    before = (np.cumsum(used) - used).reshape(segments, LANES)[:, 0]
    crcs = [zlib.crc32(raw[4 * k * size : 4 * (k + 1) * size]) for k in range(segments)]
    body = b"".join(
        [
            np.stack([np.array([d or 0 for d in docs], "<i8"), np.array([len(p) for p in parts], "<i8")], axis=1).tobytes(),
            np.stack([before.astype("<u8"), np.array(crcs, "<u8")], axis=1).tobytes(),
            state.astype("<u8").tobytes(),
            used.astype("<u2").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )
    length = len(MAGIC) + 80 + len(body) + 4
    head = MAGIC + struct.pack("<10Q", length, first, len(docs), len(ids), segments * LANES, len(words), LANES, group, sum(d is None for d in docs), zlib.crc32(raw))
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def unpack(block: bytes, table: rans.Table) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(first position, documents without an id, doc ids, ids of each, all ids) of a block; raises ValueError if a checksum fails."""
    if block[:8] != MAGIC or struct.unpack("<I", block[-4:])[0] != zlib.crc32(block[:-4]):
        raise ValueError("damaged block")
    _, first, n_docs, n_ids, n_lanes, n_words, _, _, unnamed, crc = struct.unpack("<10Q", block[8:88])
    at = 88

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(block, kind, n, at)
        at += out.nbytes
        return out

    docs = take("<i8", 2 * n_docs).reshape(-1, 2)
    segments = n_lanes // LANES
    marks = take("<u8", 2 * segments).reshape(-1, 2)
    state, used, words = take("<u8", n_lanes), take("<u2", n_lanes).astype(np.int64), take("<u4", n_words)
    got = rans.decode(table, words, used, state, _lengths(n_ids))
    wide = np.zeros((n_lanes, STEPS), np.uint32)
    wide[:, : got.shape[1]] = got
    ids = wide.reshape(segments, LANES, STEPS).transpose(0, 2, 1).reshape(-1)[:n_ids].astype("<u4")
    raw, size = ids.tobytes(), 4 * LANES * STEPS
    for k, (_, want) in enumerate(marks.tolist()):
        if zlib.crc32(raw[k * size : (k + 1) * size]) != want:
            raise ValueError(f"segment {k} does not match its checksum")
    if zlib.crc32(raw) != crc:
        raise ValueError("the ids do not match the block's checksum")
    return first, unnamed, docs[:, 0], docs[:, 1], ids


def _place(cuts: list[int]) -> Column:
    """How many of the sorted `cuts` are not above doc_id: first among every few of them, then among those few."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    among = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    group = F.greatest(among(F.array(*[F.lit(g[0]) for g in groups])), F.lit(1))
    inside = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group)
    return (group - 1) * step + among(inside)


def _parts(ids: DataFrame, n: int) -> Column:
    """The range of doc_id that a row belongs to, from 1 on; ids that fill more than one range, and rows without one, are split by a hash of the row."""
    known = ids.where("doc_id is not null").count()
    missing = ids.where("doc_id is null").count()
    points = [int(x) for x in ids.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n))] if known else []
    cuts = sorted({*points, *(x + 1 for x in points if points.count(x) > 1 and x < (1 << 63) - 1)})
    hot = {k + 1: points.count(c) for k, c in enumerate(cuts) if points.count(c) > 1}
    spread = -(-missing * n // max(1, known + missing)) or 1
    most = max([spread, *hot.values()])
    draw = lambda ways: F.pmod(F.xxhash64("ids"), ways.cast("long")).cast("int")
    place = _place(cuts)
    salt = draw(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), place), F.lit(1))) if hot else F.lit(0)
    return F.when(F.col("doc_id").isNull(), draw(F.lit(spread))).otherwise((place + 1) * most + salt)


def write_ids(ids: DataFrame, path: str, kind: str = "<u4") -> None:
    """Write (doc_id, n, ids) in ascending doc_id order (null first). `ids` should be a stored table of `encode_ids`.

    Ranges of doc_id are cut at its quantiles; the ids before each range are
    summed from the lengths alone, so only one number for each range reaches the
    driver, and each range is sorted and coded by one task. Repeated doc_ids are
    all written, next to each other.
    """
    spark = ids.sparkSession
    counts = ids.where("seen is not null").select("seen").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    dense[counts["id"]] = counts["n"]
    frequencies = rans.scaled(dense)
    used = np.flatnonzero(frequencies)
    spark.createDataFrame([(int(k), int(frequencies[k])) for k in used], "id long, f long").coalesce(1).write.parquet(f"{path}/table")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ids.where("seen is null").select("doc_id", "n", "ids")
    placed = rows.withColumn("part", _parts(rows, 2 * n))
    starts, total = {}, 0
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((frequencies, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies, starts = shared.value
        table = rans.Table(frequencies)
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        group, first, held = None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal docs, parts, first, held
            block = pack(first, group, docs, parts, table)
            docs, parts, first, held = [], [], first + held, 0
            return pa.record_batch([pa.array([block], pa.binary())], names=["block"])

        for batch in batches:
            for doc, x, p in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("part").to_pylist(), strict=True):
                if p != group:
                    if docs:
                        yield close()
                    group, first = p, starts[p]
                docs.append(doc)
                parts.append(np.frombuffer(x.as_buffer().to_pybytes(), kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield close()
        if docs:
            yield close()

    blocks = placed.repartitionByRange(n, "part").sortWithinPartitions("part", "doc_id", "ids").mapInArrow(run, "block binary")
    # the text writer writes the bytes of a string as they are
    with shuffles_dropped(spark):
        blocks.select(F.col("block").cast("string")).write.option("maxRecordsPerFile", FILE_BLOCKS).option("lineSep", "\n").text(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    """The shared frequencies, at most one for each id of the vocabulary."""
    rows = spark.read.schema("id long, f long").parquet(f"{path}/table").toPandas()
    out = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    out[rows["id"]] = rows["f"]
    return out


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and its ids on request."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(shared.value)
        for batch in batches:
            for file in batch.column("content"):
                content, at = file.as_buffer(), 0
                while at < content.size:
                    (length,) = struct.unpack("<Q", content[at + 8 : at + 16].to_pybytes())
                    first, unnamed, docs, sizes, ids = unpack(content[at : at + length].to_pybytes(), table)
                    at += length + 1
                    ends = np.cumsum(sizes)
                    raw = ids.tobytes()
                    crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    columns = [pa.array(docs, mask=np.arange(len(docs)) < unnamed), pa.array(first + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.record_batch(columns, names=schema_names)

    schema_names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/blocks").where("length > 0").select("content")
    return files.mapInArrow(run, schema)


def token_archive(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encode, write and return the archive's folder. Null texts are empty and hold the end id alone; an empty table gives no block."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    ids = materialize(encode_ids(docs, tokenizer, end_id, id_col, text_col), "token-ids")
    write_ids(ids, path, id_type(vocabulary_size(tokenizer)))
    return path
