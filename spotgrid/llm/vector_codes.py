"""Vector codes: each part of a vector becomes the index of its codebook's nearest entry, found through memoised grid cells.

Components become whole numbers, ``floor(scale * x)``, and vectors are cut into
equal consecutive parts.  A part's coarse cell is its box on a grid.  An entry whose
least distance to the box exceeds another entry's greatest distance is nearest to
no point of the box; the entries left are cached under the cell, and a part is
compared exactly with its cell's entries only.  Distances to a box are sums over
components, so they come from one small table per component.

Codebooks start as the parts of the vectors with the smallest ids.  A round assigns
all parts inside the tasks that read them, sums members there, and adds the tasks'
sums up in two levels; only codebooks, whose size is a parameter, pass the driver.

Rows: vectors that are null or hold a null, NaN or infinite component are left out;
shorter vectors are filled up with zeros to the longest one's parts; vectors
without components are zeros; of equal ids the smaller vector comes first among the
starting entries; a null id comes last there and is coded like any other; repeated
rows are coded each and count each; fewer vectors than entries make a smaller
codebook; an empty table gives an empty table; other columns are ignored.  Whole
numbers too large for a long sum of squares count as the largest that fits
(2**27 at 64 components).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from spotgrid.llm.common import stored
from spotgrid.llm.registry import query, table

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Parts assigned in one vectorised pass; cells remembered per part position.
PASS_ROWS, CACHE_CELLS = 512, 16_384
#: Tasks whose sums meet in one group.
GROUP_TASKS = 512
#: A label with more than one row in so many is joined by broadcast: there are fewer than this many such labels.
HEAVY_SHARE = 4096


def usable(column: str) -> Column:
    """True for vectors that take part."""
    x = F.col(column).cast("array<double>")
    return F.coalesce(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def limit_of(width: int) -> int:
    """Largest component whose sums of ``width`` squared differences fit a long."""
    return math.isqrt(2**62 // max(1, width)) // 2


def whole_numbers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """Usable vectors as rows of whole numbers, filled up with zeros."""
    values = np.asarray(pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
    most = limit_of(width)
    whole = np.clip(np.floor(values * scale), -most, most).astype(np.int64)
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = whole
    return out


class CellCache:
    """The nearest entry of a codebook, by the entries that a grid cell leaves possible."""

    def __init__(self, codebook: np.ndarray, side: int, most: int = CACHE_CELLS) -> None:
        self.codebook, self.side, self.most = codebook, side, most
        self.cells: dict[bytes, np.ndarray] = {}
        self.evaluated = self.worked_out = 0

    def _possible(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries that no other one dominates across each cell's box, in ascending order."""
        least = np.zeros((len(cells), len(self.codebook)), dtype=np.int64)
        greatest = np.zeros_like(least)
        for j in range(cells.shape[1]):
            at, place = np.unique(cells[:, j], return_inverse=True)
            low = at[:, None] * self.side
            below, above = low - self.codebook[:, j], self.codebook[:, j] - (low + self.side - 1)
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[place]
            greatest += (far * far)[place]
        kept = least <= greatest.min(axis=1)[:, None]
        rows, entries = np.nonzero(kept)
        return np.split(entries, np.searchsorted(rows, np.arange(1, len(cells))))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties to the lower) and the squared distance of each point."""
        cells = np.ascontiguousarray(np.floor_divide(points, self.side))
        keys = [row.tobytes() for row in cells]
        places = {key: i for i, key in enumerate(keys)}
        if len(self.cells) + len(places) > self.most:
            self.cells = {key: self.cells[key] for key in places if key in self.cells}
        new = [(key, i) for key, i in places.items() if key not in self.cells]
        if new:
            self.worked_out += len(new)
            self.cells.update(zip((key for key, _ in new), self._possible(cells[[i for _, i in new]])))
        possible = [self.cells[key] for key in keys]
        counts = np.array([len(p) for p in possible])
        entries = np.concatenate(possible)
        gaps = np.repeat(points, counts, axis=0) - self.codebook[entries]
        distances = np.einsum("ij,ij->i", gaps, gaps)
        self.evaluated += len(entries)
        starts = np.cumsum(counts) - counts
        best = np.minimum.reduceat(distances, starts)
        rows = np.repeat(np.arange(len(points)), counts)
        hits = np.flatnonzero(distances == best[rows])
        return entries[hits[np.searchsorted(rows[hits], np.arange(len(points)))]], best


def cell_side(codebook: np.ndarray) -> int:
    """Half the usual spread of a codebook's components, as a power of two."""
    spread = float(np.median(codebook.std(axis=0))) if codebook.size else 0.0
    return 1 << max(0, math.floor(math.log2(spread / 2))) if spread > 2 else 1


class Codebooks:
    """One codebook per part, as whole numbers of shape (parts, entries, components)."""

    def __init__(self, entries: np.ndarray, scale: int) -> None:
        self.entries, self.scale = entries, scale
        self.width = entries.shape[0] * entries.shape[2]
        self.sides = [cell_side(part) for part in entries]

    def caches(self) -> list[CellCache]:
        """A cache per part, for one task."""
        return [CellCache(part, side) for part, side in zip(self.entries, self.sides)]

    def assign(self, caches: list[CellCache], vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Passes of ``(points, codes, distances)`` with one column per part."""
        for at in range(0, len(vectors), PASS_ROWS):
            points = whole_numbers(vectors.slice(at, PASS_ROWS), self.width, self.scale).reshape(-1, *self.entries.shape[::2])
            found = [cache.nearest(np.ascontiguousarray(points[:, part])) for part, cache in enumerate(caches)]
            yield points, np.stack([codes for codes, _ in found], axis=1), np.stack([d for _, d in found], axis=1)

    def sha256(self) -> str:
        """Digest of all components in decimal, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _sums(books: Codebooks):
    """One row per task with the counts and sums of all entries' members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = books.caches()
        parts, entries, _ = books.entries.shape
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros_like(books.entries)
        for batch in batches:
            for points, codes, _ in books.assign(caches, batch.column(0)):
                for part in range(parts):
                    counts[part] += np.bincount(codes[:, part], minlength=entries)
                    np.add.at(sums[part], codes[:, part], points[:, part])
        if counts.any():
            group = TaskContext.get().partitionId() // GROUP_TASKS
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([counts.tobytes()]), pa.array([sums.tobytes()])], names=["group", "counts", "sums"])

    return run


def _add_up(rows: pa.Table) -> pa.Table:
    """One row with the sums of a group's arrays."""
    totals = [sum(np.frombuffer(value, dtype=np.int64) for value in rows.column(name).to_pylist()).tobytes() for name in ("counts", "sums")]
    return pa.table({"group": pa.array([0], pa.int64()), "counts": pa.array([totals[0]], pa.binary()), "sums": pa.array([totals[1]], pa.binary())})


SUMS = "group bigint, counts binary, sums binary"


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over the usable rows of ``key, vector``; None without rows."""
    values = vectors.where(usable(vector)).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    longest = values.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts)) * parts
    first = [r["v"] for r in values.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).collect()]
    start = whole_numbers(pa.array(first, pa.list_(pa.float64())), width, scale)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        partial = values.select("v").mapInArrow(_sums(books), SUMS)
        rows = partial.groupBy("group").applyInArrow(_add_up, SUMS).groupBy("group").applyInArrow(_add_up, SUMS).collect()
        counts = np.frombuffer(rows[0]["counts"], dtype=np.int64).reshape(books.entries.shape[:2])[:, :, None]
        sums = np.frombuffer(rows[0]["sums"], dtype=np.int64).reshape(books.entries.shape)
        moved = np.where(counts > 0, np.floor_divide(sums, np.maximum(counts, 1)), books.entries)
        books = Codebooks(moved, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Usable rows of ``vectors`` without the vector, with ``codes`` (a byte per part) and ``error``, a long."""
    rest = [c for c in vectors.columns if c != vector]
    clash = {"codes", "error"} & set(rest)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    if books.entries.shape[1] > 256:
        raise ValueError("a code has one byte")
    used = vectors.where(usable(vector)).select(*rest, F.col(vector).cast("array<double>"))
    schema = StructType([*(used.schema[c] for c in rest), StructField("codes", BinaryType()), StructField("error", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = books.caches()
        for batch in batches:
            codes, errors = [np.zeros((0, len(caches)), dtype=np.uint8)], [np.zeros(0, dtype=np.int64)]
            for _, found, distances in books.assign(caches, batch.column(len(rest))):
                codes.append(found.astype(np.uint8))
                errors.append(distances.sum(axis=1))
            packed = pa.array([row.tobytes() for row in np.concatenate(codes)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], packed, pa.array(np.concatenate(errors))], names=schema.names)

    return used.mapInArrow(run, schema)


def label_totals(rows: DataFrame, label: str, value: str, out: str) -> DataFrame:
    """``rows``, a stored table, with ``out``: the sum of ``value`` over rows of the same label, nulls together.

    Labels of many rows are few, whatever the table's size, and are broadcast; the
    others have a bounded share of the rows each and meet by an ordinary join.
    """
    total = F.least(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
    sums = stored(rows.groupBy(F.col(label).alias("the_label")).agg(F.count(F.lit(1)).alias("the_rows"), total.alias(out)), "label-sums")
    most = -(-rows.count() // HEAVY_SHARE)
    heavy, light = sums.where(F.col("the_rows") > most), sums.where(F.col("the_rows") <= most)
    same = F.col(label).eqNullSafe(F.col("the_label"))
    known = rows.join(F.broadcast(heavy), same, "left")
    done, rest = known.where(F.col("the_rows").isNotNull()), known.where(F.col("the_rows").isNull())
    columns = [*rows.columns, out]
    return done.select(*columns).unionByName(rest.select(*rows.columns).join(light, same).select(*columns))


def _op13_sql() -> str:
    """Rounds unrolled; sums and distances are whole numbers that a double holds exactly."""
    steps = []

    def assign(i: int) -> None:
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, part, min(CAST(d AS BIGINT) * 256 + entry) AS best FROM (
    SELECT p.r, p.part, c.entry, list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS d
    FROM p JOIN c{i} c ON c.part = p.part) GROUP BY r, part)""")

    for i in range(ROUNDS):
        assign(i)
        steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT part, entry, list(floor(s / n) ORDER BY i) AS v FROM (
      SELECT p.part, a.best % 256 AS entry, i, sum(p.v[i + 1]) AS s, count(*) AS n
      FROM p JOIN a{i} a ON a.r = p.r AND a.part = p.part, w, range(w.width) t(i) GROUP BY ALL) GROUP BY part, entry
  ) m ON m.part = c.part AND m.entry = c.entry)""")
    assign(ROUNDS)
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (SELECT max(len(q)) // 4 AS width FROM k),
p AS MATERIALIZED (SELECT r, part, q[part * width + 1 : (part + 1) * width] AS v FROM k, w, range(4) t(part)),
c0 AS (SELECT part, r - 1 AS entry, v FROM p WHERE r <= 256),{",".join(steps)},
e AS (
  SELECT r, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
), s AS (
  SELECT sha256(string_agg(t, ',' ORDER BY part, entry)) AS h
  FROM (SELECT part, entry, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS t FROM c{ROUNDS})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN e USING (r), s
"""


RESULT = StructType([
    StructField("vec_id", LongType()), StructField("code", StringType()), StructField("error", LongType()),
    StructField("label_error", LongType()), StructField("codebooks_sha256", StringType()),
])


@query("op13_vector_codes", _op13_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, errors by label, and the digest of the codebooks."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = fit(rows)
    if books is None:
        return spark.createDataFrame([], RESULT)
    coded = stored(encode(rows, books).select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error"), "vector-codes")
    return label_totals(coded, "label", "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
