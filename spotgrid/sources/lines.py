"""Numbered lines of text files, read in byte ranges.

Files are cut into ranges of a fixed number of bytes, whatever the session's split
settings are; a line belongs to the range that it begins in.  One pass counts the
lines of every range, the other reads them, and a line's number is its place in the
range plus the lines of the ranges before it.  Nothing is read before the result
is, and no text is written or shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import bounded

RANGE_BYTES = 32 * 1024 * 1024

# Bytes read at once behind a range, and of text in one batch.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 8 << 20

COMPRESSED = ("gz", "bz2", "zst", "lz4")

BLANK = b" \t\n\x0b\f\r"
MARK = b"\xef\xbb\xbf"


@dataclass
class Range(InputPartition):
    """Bytes ``low`` to ``high`` of a file; ``high`` is None for a file that can only be read as a whole."""

    file_no: int
    range_no: int
    uri: str
    low: int
    high: int | None


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def ranges_of(uris: list[str], range_bytes: int) -> list[Range]:
    """All ranges of files, in order; a compressed file is one."""
    out = []
    for number, uri in enumerate(uris):
        system, path = _opened(uri)
        size = system.get_file_info(path).size
        if path.rsplit(".", 1)[-1] in COMPRESSED:
            out.append(Range(number, 0, uri, 0, None))
            continue
        lows = range(0, max(size, 1), range_bytes)
        out += [Range(number, i, uri, low, min(size, low + range_bytes)) for i, low in enumerate(lows)]
    return out


def _line_end(data: bytes, at: int) -> int:
    """Where the first line break at ``at`` or later begins; -1 if there is none."""
    found = [x for x in (data.find(b"\n", at), data.find(b"\r", at)) if x >= 0]
    return min(found, default=-1)


def lines_of(part: Range) -> Iterator[bytes]:
    """Lines that begin in a range, without their breaks and without blank ones."""
    system, path = _opened(part.uri)
    if part.high is None:
        with system.open_input_stream(path, compression="detect") as stream:
            yield from _lines_of_stream(stream)
        return
    with system.open_input_file(path) as file:
        first = max(0, part.low - 1)
        file.seek(first)
        data = file.read(part.high - first)
        start = 0
        if part.low:
            # The break that ends the line of the range before; it may reach past the border, or lie behind it.
            end = _line_end(data, 0)
            if end < 0:
                return
            start = end + (2 if data[end : end + 2] == b"\r\n" else 1)
            if end == len(data) - 1 or start >= len(data):
                return
        elif data.startswith(MARK):
            start = len(MARK)
        data = data[start:]
        while data and data[-1:] not in (b"\n", b"\r"):
            more = file.read(CHUNK_BYTES)
            if not more:
                break
            end = _line_end(more, 0)
            data += more if end < 0 else more[: end + 1]
    yield from (line for line in data.splitlines() if line.strip(BLANK))


def _lines_of_stream(stream) -> Iterator[bytes]:
    """Lines of a file that is read from its beginning, in bounded memory."""
    held = stream.read(len(MARK)).removeprefix(MARK)
    while more := stream.read(CHUNK_BYTES):
        held += more
        whole = held[: max(held.rfind(b"\n"), held[:-1].rfind(b"\r")) + 1]  # a break at the very end may have a second half
        held = held[len(whole) :]
        yield from (line for line in whole.splitlines() if line.strip(BLANK))
    yield from (line for line in held.splitlines() if line.strip(BLANK))


class RangeReader(DataSourceReader):
    """Counts or lines of ranges."""

    def __init__(self, options: dict[str, str]) -> None:
        self.uris, self.range_bytes, self.counted = json.loads(options["uris"]), int(options["range_bytes"]), options["what"] == "counts"

    def partitions(self) -> list[Range]:
        return ranges_of(self.uris, self.range_bytes) or [Range(0, 0, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        if self.counted:
            yield self._batch(partition, 0, [str(sum(1 for _ in lines_of(partition)))])
            return
        held, size, first = [], 0, 0
        for line in lines_of(partition):
            held.append(line.decode("utf-8", "replace"))
            size += len(line)
            if size >= BATCH_BYTES:
                yield self._batch(partition, first, held)
                held, size, first = [], 0, first + len(held)
        if held:
            yield self._batch(partition, first, held)

    def _batch(self, part: Range, first: int, values: list[str]) -> pa.RecordBatch:
        n = len(values)
        arrays = [pa.array([part.file_no] * n, pa.int32()), pa.array([part.range_no] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(values, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "range", "place", "value"])


class RangeLines(DataSource):
    """``file, range, place, value`` of all non-blank lines, or one row per range with their number as the value."""

    @classmethod
    def name(cls) -> str:
        return "range_lines"

    def schema(self) -> str:
        return "file int, range bigint, place bigint, value string"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def reachable(uris: list[str]) -> bool:
    """True if the files' store can be read without Spark."""
    try:
        return all(_opened(u)[0].get_file_info(_opened(u)[1]).type == fs.FileType.File for u in uris[:1])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file_no, line, total_line, value)`` of every non-blank line, counted from 0 in file order.

    Files are in the order of their names; a file without lines has no number.  The
    table of ranges is ordered in one task and broadcast if its size allows it.
    """
    uris = sorted(spark.read.text(path).inputFiles())
    if not reachable(uris):
        return _numbered_by_spark(spark, path)
    spark.dataSource.register(RangeLines)

    def ranges(what: str) -> DataFrame:
        return spark.read.format("range_lines").options(uris=json.dumps(uris), range_bytes=str(range_bytes), what=what).load()

    counts = ranges("counts").select("file", "range", F.col("value").cast("bigint").alias("_n"))
    n = len(ranges_of(uris, range_bytes))
    shifts = bounded(_shifts(counts, "range", n), n, 64)
    joined = ranges("lines").join(shifts, ["file", "range"])
    line = F.col("_in_file") + F.col("place")
    return joined.select("file_no", line.alias("line"), (line + F.col("_before")).alias("total_line"), "value")


def _shifts(counts: DataFrame, part: str, n: int | None = None) -> DataFrame:
    """``(file, part, file_no, _in_file, _before)``: lines before each part in its file, and before the file; of ``n`` parts, if known."""
    in_file = Window.partitionBy("file").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_in_file", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    files = counts.groupBy("file").agg(F.sum("_n").alias("_total")).where(F.col("_total") > 0)
    by_name = Window.orderBy("file")
    before = F.coalesce(F.sum("_total").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = files.select("file", (F.row_number().over(by_name) - 1).alias("file_no"), before.alias("_before"))
    return placed.join(numbers if n is None else bounded(numbers, n, 32), "file").select("file", part, "file_no", "_in_file", "_before")


def _numbered_by_spark(spark: SparkSession, path: str) -> DataFrame:
    """:func:`numbered_lines` for a store that Spark alone can read: the lines are materialised with ids that rise inside each block."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    kept = cut_lineage(text.where(F.col("value").rlike("\\S")).withColumn("_id", F.monotonically_increasing_id()))
    counts = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    shifts = _shifts(counts.select("file", "block", "_n"), "block").join(counts.select("file", "block", "_first"), ["file", "block"])
    joined = kept.join(shifts, ["file", "block"])
    line = F.col("_in_file") + F.col("_id") - F.col("_first")
    return joined.select("file_no", line.alias("line"), (line + F.col("_before")).alias("total_line"), "value")
