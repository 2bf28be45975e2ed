r"""WARC: a chunked record table written as archives and read back.

A payload becomes rows of (record, chunk number, bytes), each with the digest of
all chunks so far, so the last row carries the payload's digest; nothing after
the source row holds a payload whole.  Records with equal payloads of
``min_bytes`` or more keep one response, that of the smallest key; the others
become revisit records without a payload.  A chunk is written as a WARC segment
(the first as ``response``, later ones as ``continuation`` records), a task's
archive as gzip files of at most ``FILE_CHUNKS`` segments.  Reading streams a
file through an inflater and yields rows of at most ``CHUNK_BYTES`` again, whatever
the length of a block.  Digests are added up row by row, and no bytes are kept: a
first pass finishes the records that lie in one file and names the others, whose
rows a second pass brings together by record and streams in order.

Rows: a null payload is empty and is a record like any other; null keys are the
largest and repeated rows separate records, of which one is the response; urls may
be null; an empty table gives no archive and an empty result; other columns are
ignored.  Text payloads are UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotgrid.llm.common import stored
from spotgrid.llm.registry import query, table
from spotgrid.plans.session import shared_folder
from spotgrid.plans.sizing import bounded

CHUNK_BYTES, FILE_CHUNKS = 256 << 10, 256
#: Bytes of one record's fate in a broadcast.
FATE_BYTES = 200
DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNKS = "record_id string, key bigint, url string, chunk int, last boolean, data binary, so_far bigint, digest string"


def base32_sha1(digest: bytes) -> str:
    """Upper-case base32 of a SHA-1 digest."""
    return base64.b32encode(digest).decode()


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])


def _batches(rows: Iterator[tuple], kinds: list[tuple[str, pa.DataType]], data_at: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches of bounded bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[data_at] or b"") + 200
        if size >= most_bytes:
            yield _batch(held, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, kinds)


_CHUNK_KINDS = [
    ("record_id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()),
    ("data", pa.binary()), ("so_far", pa.int64()), ("digest", pa.string()),
]


def chunk_records(pages: DataFrame, key: str, payload: str, url: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``pages``: ``record_id, key, url, chunk, last, data, so_far, digest``.

    ``so_far`` and ``digest`` cover the payload up to and with the chunk.  Record ids
    number the rows of each task; store the table before it is used twice.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k, u, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held = data.as_buffer()  # no copy
                view = memoryview(held if held is not None else b"")
                sha, record = hashlib.sha1(), f"urn:record:{part}-{number}"
                for chunk, at in enumerate(range(0, max(1, len(view)), chunk_bytes)):
                    piece = view[at : at + chunk_bytes]
                    sha.update(piece)
                    yield record, k, u, chunk, at + chunk_bytes >= len(view), bytes(piece), at + len(piece), base32_sha1(sha.digest())
                number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _CHUNK_KINDS, 5)

    named = pages.select(
        F.col(key).cast("bigint").alias("key"), (F.col(url) if url else F.lit(None)).cast("string").alias("url"), F.col(payload).cast("binary").alias("data")
    )
    return named.mapInArrow(run, CHUNKS)


def find_revisits(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``record_id, refers_id, total, digest_all`` per record; ``refers_id`` is null for responses.

    The response of equal payloads is the record of the smallest key.
    """
    ends = chunks.where("last").select("record_id", "key", F.col("so_far").alias("total"), F.col("digest").alias("digest_all"))
    order = F.struct(F.col("key").isNull().alias("no_key"), F.col("key").alias("key"), F.col("record_id").alias("record_id"))
    heads = ends.where(F.col("total") >= min_bytes).groupBy("digest_all", "total").agg(F.min(order).alias("head"))
    heads = heads.select("digest_all", "total", F.col("head.record_id").alias("head_id"))
    joined = ends.join(heads, ["digest_all", "total"], "left")
    refers = F.when(F.col("head_id") != F.col("record_id"), F.col("head_id"))
    return joined.select("record_id", refers.alias("refers_id"), "total", "digest_all")


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(chunks: DataFrame, path: str, min_bytes: int = 0, file_chunks: int = FILE_CHUNKS) -> None:
    """Write a stored chunk table as gzip WARC files; only chunks of responses keep their bytes."""
    fates = stored(find_revisits(chunks, min_bytes), "fates")
    # Fates travel and payloads stay where they are, as long as the fates are small.
    n = fates.count()
    side = bounded(fates, n, FATE_BYTES)
    wanted = chunks.join(side, "record_id").where(F.col("refers_id").isNull() | (F.col("chunk") == 0))
    if side is fates:
        wanted = wanted.sortWithinPartitions("record_id", "chunk")
    revisit, first = F.col("refers_id").isNotNull(), F.col("chunk") == 0
    many = ~(first & F.col("last"))
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    own_id = F.when(first, F.col("record_id")).otherwise(F.concat("record_id", F.lit(":"), F.col("chunk").cast("string")))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    url = F.regexp_replace("url", r"[\r\n]", "")
    block = F.concat(F.when(first, HTTP_HEAD).otherwise(""), F.when(revisit, F.lit("")).otherwise(F.col("data").cast("string")))
    header = F.concat(
        F.lit(VERSION + "\r\n"),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", angle(own_id)),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", url),
        _field("X-Record-Key", F.col("key")),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest_all"))),
        _field("WARC-Refers-To", angle(F.col("refers_id"))),
        _field("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Segment-Number", F.when(~revisit & many, F.col("chunk") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~revisit & ~first, angle(F.col("record_id")))),
        _field("WARC-Segment-Total-Length", F.when(~revisit & ~first & F.col("last"), F.col("total") + len(HTTP_HEAD))),
        _field("Content-Type", F.when(first, "application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    text = wanted.select(F.concat(header, block).alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_chunks).text(path)


def _pieces(content: bytes, most: int = CHUNK_BYTES, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """Blocks of a gzip archive's records in pieces of at most ``most`` bytes: header fields, number of the piece, bytes, and whether it is the last.

    Inflated step by step; never more than a piece, a step and a header is held.
    """
    inflater, view, at = zlib.decompressobj(31), memoryview(content), 0
    held = bytearray()

    def more() -> bool:
        nonlocal inflater, at
        if inflater.unconsumed_tail:
            held.extend(inflater.decompress(inflater.unconsumed_tail, step))
            return True
        if at >= len(view):
            return False
        if inflater.eof:  # the next gzip member
            inflater = zlib.decompressobj(31)
        piece = view[at : at + step]
        held.extend(inflater.decompress(piece, step))
        at += len(piece) - len(inflater.unused_data)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("an archive ends inside a header")
                return
        lines = bytes(held[:end]).decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record but {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        del held[: end + 4]
        left, number = int(fields["Content-Length"]), 0
        while left or not number:
            size = min(left, most)
            while len(held) < size:
                if not more():
                    raise ValueError("an archive ends inside a record")
            piece = bytes(held[:size])
            del held[:size]
            left -= size
            yield fields, number, piece, not left
            number += 1
        while len(held) < 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        del held[:4]


READ = "record_id string, key bigint, url string, type string, refers_id string, chunk int, piece int, ends boolean, last boolean, data binary, stated string"
_READ_KINDS = [
    ("record_id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_id", pa.string()), ("chunk", pa.int32()),
    ("piece", pa.int32()), ("ends", pa.bool_()), ("last", pa.bool_()), ("data", pa.binary()), ("stated", pa.string()),
]


def _read_row(fields: dict[str, str], piece: int, data: bytes, ends: bool) -> tuple:
    first = fields["WARC-Type"] != "continuation"
    record = fields["WARC-Record-ID" if first else "WARC-Segment-Origin-ID"][1:-1]
    number = int(fields.get("WARC-Segment-Number", 1))
    last = ends and ("WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields)
    key = fields.get("X-Record-Key")
    refers = fields.get("WARC-Refers-To")
    if first and piece == 0:
        data = data.partition(b"\r\n\r\n")[2]  # behind the HTTP header
    stated = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    return record, int(key) if key else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], refers and refers[1:-1], number - 1, piece, ends, last, data, stated


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all archives below ``path``: ``record_id, key, url, type, refers_id, chunk, piece, ends, last, data, stated``.

    A row is a piece of a segment, ``ends`` marks the segment's last piece and ``last``
    the record's; ``stated`` is the payload digest named in the header of a record's
    first segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (c.as_buffer() for batch in batches for c in batch.column(0))
        return _batches((_read_row(*p) for c in contents for p in _pieces(c)), _READ_KINDS, 9)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("content").mapInArrow(run, READ)


SUMMED = "record_id string, key bigint, url string, type string, refers_id string, stated string, total bigint, digest string"
_SUMMED_KINDS = [
    ("record_id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("refers_id", pa.string()),
    ("stated", pa.string()), ("total", pa.int64()), ("digest", pa.string()),
]


def _sum_runs(all_must_end: bool):
    """Fold the rows of each record, from its first to its last one in order, into one row with total and digest.

    A record that does not end where it is read, or began elsewhere, gives a row
    without a digest, or raises.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sha, head, total, due, named = hashlib.sha1(), None, 0, (0, 0), None

        def unfinished(record: str) -> tuple:
            if all_must_end:
                raise ValueError(f"record {record} has no last chunk")
            return (record, *[None] * (len(_SUMMED_KINDS) - 1))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in ("record_id", "chunk", "piece", "ends", "last")]
            for i, (record, chunk, piece, ends, last) in enumerate(zip(*(c.to_pylist() for c in columns))):
                if head is None or head[0] != record or (chunk, piece) != due:
                    if head is not None:
                        yield unfinished(head[0])
                        named, head = head[0], None
                    if (chunk, piece) != (0, 0):
                        if named != record:
                            yield unfinished(record)
                            named = record
                        continue
                    head = tuple(batch.column(batch.schema.get_field_index(n))[i].as_py() for n in ("record_id", "key", "url", "type", "refers_id", "stated"))
                    sha, total = hashlib.sha1(), 0
                data = memoryview(batch.column(batch.schema.get_field_index("data"))[i].as_buffer())
                sha.update(data)
                total += len(data)
                due = (chunk + 1, 0) if ends else (chunk, piece + 1)
                if last:
                    yield (*head, total, base32_sha1(sha.digest()))
                    head = None
        if head is not None:
            yield unfinished(head[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), _SUMMED_KINDS, 0)

    return run


def payload_digests(chunks: DataFrame) -> DataFrame:
    """One row per record read: ``record_id, key, url, type, refers_id, stated, total, digest``.

    Raises if a record's chunks are not all there.
    """
    near = stored(chunks.mapInArrow(_sum_runs(False), SUMMED), "digests")
    done, open_ids = near.where("digest is not null"), near.where("digest is null").select("record_id").distinct()
    n = open_ids.count()
    if not n:
        return done
    rows = chunks.join(bounded(open_ids, n, FATE_BYTES), "record_id", "left_semi")
    gathered = rows.repartition("record_id").sortWithinPartitions("record_id", "chunk", "piece")
    return done.unionByName(gathered.mapInArrow(_sum_runs(True), SUMMED))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the full payload's ``total`` and ``digest`` and, for revisits, ``refers_to``, the response's key."""
    heads = records.where(F.col("type") == "response").select(
        F.col("record_id").alias("refers_id"), F.col("key").alias("refers_to"), F.col("total").alias("head_total"), F.col("digest").alias("head_digest")
    )
    is_revisit = F.col("type") == "revisit"
    joined = records.where(is_revisit).join(heads, "refers_id", "left")
    revisits = joined.select("record_id", "key", "url", "type", "stated", F.col("head_total").alias("total"), F.col("head_digest").alias("digest"), "refers_to")
    responses = records.where(~is_revisit).select("record_id", "key", "url", "type", "stated", "total", "digest", F.lit(None).cast("bigint").alias("refers_to"))
    return responses.unionByName(revisits)


_BASE32 = "".join(
    "|| " * (i > 0)
    + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {shift}) & 31)::INTEGER, 1)" for shift in (15, 10, 5, 0))
    + " "
    for i in range(8)
)
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, row_number() OVER (PARTITION BY html ORDER BY page_id) AS n,
  min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n > 1 THEN head END AS refers_to FROM d
"""


@query("op1_warc", OP1_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives."""
    path = shared_folder(spark, "archives")
    write_archives(stored(chunk_records(table(spark, sf_dir, "pages"), "page_id", "html", "url"), "chunks"), path)
    records = resolve_revisits(stored(payload_digests(read_archives(spark, path)), "records"))
    return records.select(F.col("key").alias("page_id"), F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
