"""Two tables that meet pair by pair on executors, and matrices behind array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import fits

# Bytes of vectors that one block of a table holds.
BLOCK_BYTES = 32 * 1024 * 1024

# Groups of pieces per core, at least, so that cores have even shares.
CORE_GROUPS = 4

# Start and length of a piece's rows in the one table, then in the other.
Piece = tuple[int, int, int, int]


def as_matrix(vectors: pa.Array | pa.ChunkedArray, width: int | None = None, gaps: float | None = None) -> np.ndarray:
    """Vectors as rows of one matrix of doubles; a null vector is a row of zeros.

    ``gaps`` takes the place of missing components, null or NaN.  Vectors of
    another length than the others, or than ``width``, raise.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    given = sizes >= 0
    wide = int(sizes.max(initial=0)) if width is None else width
    if np.any(sizes[given] != wide):
        raise ValueError(f"a vector has not the {wide} components of the others")
    flat = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    if gaps is not None:
        flat = np.where(np.isnan(flat), gaps, flat)
    if given.all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide))
    out[given] = flat.reshape(-1, wide)
    return out


def as_vectors(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array column."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def rows_and_bytes(table: DataFrame, *vectors: str) -> tuple[int, int]:
    """Number of rows, and the bytes of a row with the longest vectors."""
    widths = [F.coalesce(F.max(F.size(v)), F.lit(0)) for v in vectors]
    n, *found = table.agg(F.count(F.lit(1)), *widths).first()
    return n, 16 + 8 * sum(max(0, w) for w in found)


def small_table(table: DataFrame, limit: int, *vectors: str) -> pa.Table | None:
    """All rows of a table whose counted size is below ``limit``, else None."""
    n, row = rows_and_bytes(table, *vectors)
    return table.toArrow() if fits(n, row, limit) else None


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with a unique ``_row`` that no later job changes."""
    return cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))


def _by_cell(rows: pa.Table, cells: tuple[str, ...]) -> tuple[pa.Table, dict[tuple, tuple[int, int]]]:
    """Rows of equal ``cells`` beside one another, in one chunk, and where each of these runs lies: its start and length."""
    if not rows.num_rows:
        return rows, {}
    rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in cells])).combine_chunks()
    columns = [rows.column(c).combine_chunks() for c in cells]
    changes = np.ones(rows.num_rows, dtype=bool)
    changes[1:] = np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in columns])
    starts = np.flatnonzero(changes)
    sizes = np.diff(np.append(starts, rows.num_rows))
    keys = zip(*(c.take(pa.array(starts)).to_pylist() for c in columns))
    return rows, dict(zip(keys, zip(starts.tolist(), sizes.tolist())))


def meet(
    left: DataFrame,
    right: DataFrame,
    left_rows: int,
    right_rows: int,
    work: Callable[[pa.Table, pa.Table, list[Piece]], pa.Table],
    schema: str,
    by: str | None = None,
) -> DataFrame:
    """``work`` on every pair of a block of ``left`` and a block of ``right``, of the same ``by`` if given.

    Rows are dealt into blocks of about ``left_rows`` and ``right_rows`` rows by
    hashes of ``_row`` and ``_id``; the number of blocks follows from counts, per
    ``by``, so that a ``by`` with most of the rows only has more blocks.  Each pair of
    blocks is one piece of a task's work.  Small pieces share a group: ``work`` gets the
    rows of a group, sorted so that each piece is a slice of both tables, and these
    slices; what it does once per group does not grow with the number of pieces.  Rows
    of a null ``by`` meet nothing.
    """
    key = F.lit(0) if by is None else F.col(by)
    # Both tables may come from one; only columns of their own go on.
    left, right = (rows.withColumn("_by", key).drop(*([by] if by else [])) for rows in (left, right))
    counted = left.groupBy("_by").agg(F.count(F.lit(1)).alias("_l")).join(right.groupBy("_by").agg(F.count(F.lit(1)).alias("_r")), "_by")
    sizes = cut_lineage(counted.select("_by", "_l", "_r", F.ceil(F.col("_l") / left_rows).alias("_lb"), F.ceil(F.col("_r") / right_rows).alias("_rb")))
    moved = sizes.agg(F.sum(F.col("_l") * F.col("_rb") / left_rows + F.col("_r") * F.col("_lb") / right_rows)).first()[0] or 0
    groups = max(CORE_GROUPS * left.sparkSession.sparkContext.defaultParallelism, -(-int(moved) // 2))
    sizes = F.broadcast(sizes) if by is None else sizes
    zero = F.lit(0).cast("bigint")

    def placed(rows: DataFrame, own: str, number: str, blocks: str, other: str, others: str) -> DataFrame:
        dealt = rows.join(sizes, "_by").withColumn(own, F.pmod(F.xxhash64(number), F.col(blocks)))
        copied = dealt.withColumn(other, F.explode(F.sequence(zero, F.col(others) - 1)))
        return copied.withColumn("_group", F.pmod(F.xxhash64("_by", "_at", "_to"), F.lit(groups))).drop("_l", "_r", "_lb", "_rb")

    cells = ("_by", "_at", "_to")
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def piecewise(one: pa.Table, two: pa.Table) -> pa.Table:
        (one, first), (two, second) = _by_cell(one, cells), _by_cell(two, cells)
        pieces = [(*first[cell], *second[cell]) for cell in first if cell in second]
        return work(one, two, pieces) if pieces else nothing

    a = placed(left, "_at", "_row", "_lb", "_to", "_rb")
    b = placed(right, "_to", "_id", "_rb", "_at", "_lb")
    return a.groupBy("_group").cogroup(b.groupBy("_group")).applyInArrow(piecewise, schema)


def merged_runs(rows: DataFrame, keys: list[str], add: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]], vectors: list[str], plain: list[str]) -> DataFrame:
    """Rows of equal integer ``keys`` as one row each, without a group in memory.

    Equal keys are brought together and sorted, and ``add(columns, starts)`` merges
    the runs that begin at ``starts``; a run that reaches past a batch is carried on.
    ``columns`` are the matrices of ``vectors``, then the arrays of ``plain``.
    """
    names = [*keys, *vectors, *plain]
    chosen = rows.select(*names).repartition(*keys).sortWithinPartitions(*keys)
    ids, matrices = len(keys), len(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        kinds: list[pa.DataType] = []

        def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
            arrays = [pa.array(c).cast(kind) for c, kind in zip(columns[:ids], kinds)]
            arrays += [*map(as_vectors, columns[ids : ids + matrices]), *map(pa.array, columns[ids + matrices :])]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(i).type for i in range(ids)]
            columns = [batch.column(i).to_numpy() for i in range(ids)]
            columns += [as_matrix(batch.column(ids + i)) for i in range(matrices)]
            columns += [batch.column(ids + matrices + i).to_numpy() for i in range(len(plain))]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            changes = np.zeros(len(columns[0]), dtype=bool)
            changes[0] = True
            for c in columns[:ids]:
                changes[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(changes)
            columns = [c[starts] for c in columns[:ids]] + add(columns[ids:], starts)
            held = [c[-1:] for c in columns]
            if len(starts) > 1:
                yield batch_of([c[:-1] for c in columns])
        if held is not None:
            yield batch_of(held)

    return chosen.mapInArrow(run, chosen.schema)
