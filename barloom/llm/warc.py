"""WARC archives with revisit records for payloads that an archive holds already."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, shuffles_dropped, text_slices

#: Equal payloads under so many bytes are all kept as responses.
LEAST_BYTES = 1000
#: An archive is closed when it holds so many bytes, compressed.
FILE_BYTES = 16 << 20
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BLANK = re.compile("[\x00-\x20\x7f]")


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, digest, original, original_url) of each page that revisits another, from headers (page_id, key, url, digest, n) alone.

    Of equal payloads of at least `least_bytes` the page with the largest id is
    the response. Minima and maxima are taken on each side of the shuffle, and
    the join on the digest reads two stored tables, so a digest that many pages
    share can be split.
    """
    headers = materialize(headers.where(F.col("n") >= least_bytes), "warc-headers")
    largest = headers.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("copies")).where("copies > 1").select("digest", "original")
    largest = materialize(largest, "warc-originals")
    named = largest.join(headers.select(F.col("page_id").alias("original"), "digest", "url"), ["digest", "original"]).groupBy("digest", "original").agg(F.min("url").alias("original_url"))
    named = materialize(named, "warc-named")
    again = headers.select("page_id", "key", "digest").join(named, "digest").where(~F.col("page_id").eqNullSafe(F.col("original")))
    return again.groupBy("key", "digest").agg(F.max("original").alias("original"), F.max("original_url").alias("original_url"))


def payload(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def digest(column: str) -> Column:
    return F.sha1(payload(column))


def payload_bytes(column: str) -> Column:
    return F.octet_length(payload(column)).cast("long")


def _key(page: Column) -> Column:
    return F.coalesce(page.cast("string"), F.lit("none"))


def _record_id(key: str, digest: str, nth: int = 1) -> str:
    """Page and payload name a record; further rows of the same page and payload are numbered."""
    return f"<urn:x-page:{key}:{digest}{'' if nth == 1 else f':{nth}'}>"


def _member(record: bytes) -> bytes:
    """A gzip member of its own, so that each record can be read from its place in the file."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}{_CRLF}" for name, value in fields)
    return f"WARC/1.1{_CRLF}{head}Content-Length: {len(block)}{_CRLF * 2}".encode() + block + b"\r\n\r\n"


def _page_record(key: str, url: str | None, body: str, digest: str, original: int | None, original_url: str | None, nth: int, date: str) -> bytes:
    """A response with its payload, or a revisit record that holds the headers alone."""
    payload_ = body.encode()
    target = [("WARC-Target-URI", _BLANK.sub("%20", url))] if url is not None else []
    refers = []
    if original is not None:
        refers = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _record_id(str(original), digest))]
        refers += [("WARC-Refers-To-Target-URI", _BLANK.sub("%20", original_url))] if original_url is not None else []
    http = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=UTF-8{_CRLF}Content-Length: {len(payload_)}{_CRLF * 2}".encode()
    fields = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", _record_id(key, digest, nth)), ("WARC-Date", date), *target]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), *refers, ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, http + payload_ if original is None else http)


def _archives(date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            return pa.record_batch([pa.array([b"".join([_member(info), *held])], pa.binary())], names=["archive"])

        for part in (p for b in batches for p in text_slices(iter([b]), "body")):
            for row in zip(*(part.column(c).to_pylist() for c in ("key", "url", "body", "digest", "original", "original_url", "nth")), strict=True):
                held.append(_member(_page_record(*row, date)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write `*.warc.gz` archives, each of a warcinfo record and about `file_bytes` of records, and return their folder.

    Revisits are found from headers alone; then each page is shuffled once, body
    and all, to meet what was found. Every record is a gzip member of its own.
    Null pages are written with an empty payload and pages without an id as
    "none"; rows with the same id and payload are numbered, which brings them to
    one task. An empty table gives no archive. A record is built whole in memory.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    column = lambda name: F.col(f"`{name}`")
    named = pages.select(column(id_col).cast("long").alias("page_id"), _key(column(id_col).cast("long")).alias("key"), column(url_col).alias("url"), F.coalesce(column(payload_col), F.lit("")).alias("body"))
    named = named.withColumn("digest", digest("body"))
    again = resolve_revisits(named.select("page_id", "key", "url", "digest", payload_bytes("body").alias("n")))
    # the join and the numbering share one exchange
    nth = F.row_number().over(Window.partitionBy("key", "digest").orderBy(F.col("url").asc_nulls_last()))
    rows = named.join(again, ["key", "digest"], "left").select("key", "url", "body", "digest", "original", "original_url", nth.alias("nth"))
    date = date or spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS t").first()["t"]
    archives = rows.mapInArrow(_archives(date, file_bytes), "archive binary").select(F.col("archive").cast("string"))
    # one archive a file; the text writer writes its bytes as they are, and after them an empty gzip member as line end
    with shuffles_dropped(spark):
        archives.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", _member(b"").decode("latin-1")).text(path)
    _rename(spark, path)
    return path


def _rename(spark: SparkSession, path: str) -> None:
    """Give the writer's files the name that WARC readers look for; one call a file, no data is moved."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-"):
            files.rename(status.getPath(), hadoop.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


def _parse(content: pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive, one gzip member after another."""
    at = 0
    while at < content.size:
        unzip, record = zlib.decompressobj(31), bytearray()
        while not unzip.eof:
            piece = content[at : at + (1 << 16)].to_pybytes()
            if not piece:
                raise ValueError("an archive ends inside a record")
            record += unzip.decompress(piece)
            at += len(piece) - len(unzip.unused_data)
        if not record:
            continue
        head, _, rest = bytes(record).partition(b"\r\n\r\n")
        first, *fields = head.decode().split(_CRLF)
        named = dict(x.split(": ", 1) for x in fields)
        size = int(named.get("Content-Length", -1))
        if first != "WARC/1.1" or len(rest) != size + 4:
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        yield named, rest[:size]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a response's digest is checked against its payload."""

    def page(field: str | None) -> int | None:
        number = field[1:-1].split(":")[2] if field else "none"
        return None if number == "none" else int(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("content"):
                out: list[tuple] = []
                for head, block in _parse(file.as_buffer()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    fields, _, body = block.partition(b"\r\n\r\n")
                    n = int(next(x for x in fields.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                    told = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(body) != n or hashlib.sha1(body).hexdigest() != told):
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload is not what its header says")
                    out.append((page(head["WARC-Record-ID"]), n, told, head["WARC-Type"], page(head.get("WARC-Refers-To"))))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
