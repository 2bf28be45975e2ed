"""Sums of vectors by key, reduced inside tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from spotgrid.operators.meeting import BLOCK_BYTES, as_matrix, as_vectors, merged_runs, rows_and_bytes
from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import BROADCAST_LIMIT, fits

# Accumulators of one task are emitted when they reach this size.
TASK_LIMIT = 64 * 1024 * 1024

# Cells of one group in a projection; entries that meet one block of a large matrix in one group.
CELL_BLOCK, BLOCK_ENTRIES = 4096, 1 << 20

# Tasks whose sums are added up in a first step of their own.
MERGED_TASKS = 64


def _added(columns: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, starts, axis=0) for c in columns]


def _partial_schema(key: T.StructField) -> T.StructType:
    return T.StructType(
        [key, T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType()))]
    )


def _added(columns: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c, starts, axis=0) for c in columns]


def merge_partials(partials: DataFrame, key: str) -> DataFrame:
    """Add up ``(key, n, total)`` rows, which are at most as many per key as there are tasks.

    On a large cluster the rows of ``MERGED_TASKS`` neighbouring tasks are added up
    first, so no key has one row per task in a single place.
    """
    if partials.sparkSession.sparkContext.defaultParallelism > MERGED_TASKS:
        share = F.floor(F.spark_partition_id() / MERGED_TASKS).cast("bigint")
        partials = merged_runs(partials.withColumn("_share", share), [key, "_share"], _added, ["total"], ["n"])
    return merged_runs(partials, [key], _added, ["total"], ["n"]).select(key, "n", "total")


def sum_vectors(rows: DataFrame, key: str, limit: int = TASK_LIMIT) -> DataFrame:
    """``(key, n, total)``: count and element-wise sum of ``vec`` per integer key.

    Every task adds its vectors up per key as Arrow batches arrive, so a key with
    a third of all rows sends one vector per task into the shuffle; those are added
    up as arrays.  A null vector, or one under a null key, is no member; vectors of
    unequal length raise.
    """
    schema = _partial_schema(rows.schema[key])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        width, kind = None, None

        def emit() -> pa.RecordBatch:
            arrays = [pa.array(list(sums), kind), pa.array(list(counts.values()), pa.int64()), as_vectors(np.stack(list(sums.values())))]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(0).type
            ids = batch.column(0).to_numpy()
            vecs = as_matrix(batch.column(1), width)
            width = vecs.shape[1]
            order = np.argsort(ids, kind="stable")
            found, starts = np.unique(ids[order], return_index=True)
            added = np.add.reduceat(vecs[order], starts, axis=0)
            sizes = np.diff(np.append(starts, len(ids)))
            for i, code in enumerate(found.tolist()):
                if code in sums:
                    sums[code] += added[i]
                    counts[code] += int(sizes[i])
                else:
                    sums[code], counts[code] = added[i], int(sizes[i])
            if len(sums) * width * 8 > limit:
                yield emit()
                sums, counts = {}, {}
        if sums:
            yield emit()

    members = rows.select(key, "vec").where(F.col(key).isNotNull() & F.col("vec").isNotNull())
    return merge_partials(members.mapInArrow(partial, schema), key)


def _run_totals(rows: np.ndarray, products: np.ndarray, kind: pa.DataType) -> list[pa.Array]:
    """Row, number of products and their sum, per run of equal rows."""
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    sizes = np.diff(np.append(starts, len(rows)))
    return [pa.array(rows[starts], kind), pa.array(sizes.astype(np.int64)), as_vectors(np.add.reduceat(products, starts, axis=0))]


def sparse_times_dense(
    entries: DataFrame, row: str, col: str, value: str, dense: DataFrame, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """``(row, n, total)``: sparse matrix entries times a dense matrix ``(id, vec)``.

    A dense matrix of at most ``limit`` bytes is broadcast: entries are shuffled
    once, by row and block of columns, so a group is bounded and a row with very
    many entries is split; tasks multiply whole runs, and per run one vector leaves
    the task.  Of a larger matrix, blocks of columns meet the entries of these
    columns on executors; a block with many entries meets them in several groups.
    Null vectors count as absent.
    """
    schema = _partial_schema(entries.schema[row])
    chosen = entries.select(row, F.col(col).cast("long").alias("_col"), F.col(value).cast("double").alias("_value"))
    chosen = chosen.where((F.col("_value") != 0) & F.col("_col").isNotNull() & F.col(row).isNotNull())
    side = dense.select(F.col(dense.columns[0]).cast("long").alias("_col"), "vec").where("vec is not null")
    n, row_bytes = rows_and_bytes(side, "vec")
    if not n:
        raise ValueError("the dense matrix is empty")
    if not fits(n, row_bytes, limit):
        return merge_partials(_block_products(chosen, side, row, row_bytes, limit, schema), row)
    block = F.floor(F.col("_col") / F.lit(CELL_BLOCK))
    placed = chosen.withColumn("_block", block).repartition(row, "_block").sortWithinPartitions(row, "_block")
    held = side.toArrow()
    order = np.argsort(held.column("_col").to_numpy(), kind="stable")
    shared = entries.sparkSession.sparkContext.broadcast((held.column("_col").to_numpy()[order], as_matrix(held.column("vec"))[order]))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = batch.column(1).to_numpy()
            at = np.minimum(np.searchsorted(ids, cols), len(ids) - 1)
            hit = ids[at] == cols
            if hit.any():
                products = vectors[at[hit]] * batch.column(2).to_numpy()[hit][:, None]
                yield pa.RecordBatch.from_arrays(_run_totals(batch.column(0).to_numpy()[hit], products, batch.column(0).type), schema.names)

    return merge_partials(placed.select(row, "_col", "_value").mapInArrow(multiply, schema), row)


def _block_products(entries: DataFrame, dense: DataFrame, row: str, row_bytes: int, limit: int, schema: T.StructType) -> DataFrame:
    """Partial ``(row, n, total)`` of blocks of columns: entries cogrouped with the dense rows of their columns."""
    columns = max(1, min(limit, BLOCK_BYTES) // row_bytes)
    block = F.floor(F.col("_col") / columns)
    blocked = entries.withColumn("_block", block)
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).select("_block", F.ceil(F.col("_n") / BLOCK_ENTRIES).alias("_shares"))
    counts = cut_lineage(counts)
    kind = to_arrow_type(schema[0].dataType)
    nothing = to_arrow_schema(schema).empty_table()

    def multiply(some: pa.Table, matrix: pa.Table) -> pa.Table:
        if not some.num_rows or not matrix.num_rows:
            return nothing
        ids = matrix.column("_col").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], as_matrix(matrix.column("vec"))[order]
        rows, cols, values = (some.column(c).to_numpy() for c in (row, "_col", "_value"))
        by_row = np.argsort(rows, kind="stable")
        rows, cols, values = rows[by_row], cols[by_row], values[by_row]
        at = np.minimum(np.searchsorted(ids, cols), len(ids) - 1)
        hit = ids[at] == cols
        parts = []
        cells = max(1, BLOCK_BYTES // row_bytes)
        places = np.flatnonzero(hit)
        for start in range(0, len(places), cells):
            now = places[start : start + cells]
            parts.append(pa.Table.from_arrays(_run_totals(rows[now], vectors[at[now]] * values[now][:, None], kind), names=schema.names))
        return pa.concat_tables(parts) if parts else nothing

    left = blocked.join(counts, "_block").withColumn("_share", F.pmod(F.xxhash64(row, "_col"), F.col("_shares"))).select("_block", "_share", row, "_col", "_value")
    right = dense.withColumn("_block", block).join(counts, "_block")
    right = right.select("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_shares") - 1)).alias("_share"), "_col", "vec")
    return left.groupBy("_block", "_share").cogroup(right.groupBy("_block", "_share")).applyInArrow(multiply, schema)
