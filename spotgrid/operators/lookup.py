"""Similarity-weighted lookup of values from a reference set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotgrid.operators.meeting import BLOCK_BYTES, Piece, as_matrix, as_vectors, meet, merged_runs, numbered, rows_and_bytes, small_table
from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import BROADCAST_LIMIT

# Fixed value: factor on the cosine similarity.
SCALE = 8.0

# Elements of one similarity block in a task.
BLOCK_ELEMENTS = 1 << 22


def _heads(matrix: np.ndarray, heads: int) -> np.ndarray:
    """Rows cut into ``heads`` slices of equal length."""
    return matrix.reshape(len(matrix), heads, -1)


def _directions(matrix: np.ndarray, heads: int) -> np.ndarray:
    """Slices of unit length; a slice of zeros stays."""
    cut = _heads(matrix, heads)
    return cut / np.maximum(np.sqrt((cut * cut).sum(axis=2, keepdims=True)), 1e-12)


def _absorb(queries: np.ndarray, keys: np.ndarray, values: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peak, mass relative to it, and weighted sum per query and head, over all ``keys``."""
    n, heads, _ = queries.shape
    peak, mass = np.zeros((n, heads)), np.zeros((n, heads))
    acc = np.zeros((n, heads, values.shape[2]))
    step = max(1, BLOCK_ELEMENTS // len(keys))
    for h in range(heads):
        for at in range(0, n, step):
            scores = (queries[at : at + step, h] @ keys[:, h].T) * scale
            top = scores.max(axis=1)
            weights = np.exp(scores - top[:, None])
            peak[at : at + step, h], mass[at : at + step, h] = top, weights.sum(axis=1)
            acc[at : at + step, h] = weights @ values[:, h]
    return peak, mass, acc


def _merge(columns: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """States of several sets of keys as one per run: the exact softmax over their union."""
    peak, mass, acc = columns
    n, heads = peak.shape
    top = np.maximum.reduceat(peak, starts, axis=0)
    run = np.searchsorted(starts, np.arange(n), side="right") - 1
    shrink = np.exp(peak - top[run])
    weighted = (acc.reshape(n, heads, -1) * shrink[:, :, None]).reshape(n, -1)
    return [top, np.add.reduceat(mass * shrink, starts, axis=0), np.add.reduceat(weighted, starts, axis=0)]


def soft_lookup(
    queries: DataFrame,
    context: DataFrame,
    null_key: list[float],
    null_value: list[float],
    scale: float = SCALE,
    limit: int = BROADCAST_LIMIT,
    heads: int = 1,
    by: str | None = None,
) -> DataFrame:
    """``(query_id, result)``: softmax-weighted sum of context values.

    ``queries(query_id, vec)``, ``context(key_id, key_vec, value_vec, usable)``.
    Weights are the softmax of ``scale`` times the cosine similarity over the
    usable keys and one extra null key that is always usable.  With ``heads``, all
    vectors are cut into that many slices, each with weights of its own, and the
    results follow one another.  With ``by``, a column of both tables, a query sees
    the keys of its own ``by`` only.

    A shared context of at most ``limit`` bytes is broadcast.  Otherwise blocks of
    keys meet blocks of queries on executors; each pair of blocks gives a (peak,
    mass, weighted sum) per query, and these are merged by query, which is the exact
    softmax.  Keys with a null vector or value are not usable; a null query has no
    direction; missing components count as zero; vectors of unequal length raise.
    """
    names = ["query_id", "vec", *([by] if by else [])]
    null_keys, null_values = (np.asarray([x], dtype=np.float64) for x in (null_key, null_value))
    width = null_keys.shape[1]
    if width % heads or null_values.shape[1] % heads:
        raise ValueError(f"vectors cannot be cut into {heads} heads")
    usable = context.where(F.col("usable") & F.col("key_vec").isNotNull() & F.col("value_vec").isNotNull())
    usable = usable.select("key_id", "key_vec", "value_vec", *([by] if by else []))

    def directed(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
        return _directions(as_matrix(vectors, width, gaps=0.0), heads)

    def states(directions: np.ndarray, keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        peak, mass, acc = _absorb(directions, keys, values, scale)
        return [peak, mass, acc.reshape(len(acc), -1)]

    def result(columns: list[np.ndarray]) -> pa.Array:
        _, mass, acc = columns
        return as_vectors((_heads(acc, heads) / mass[:, :, None]).reshape(len(acc), -1))

    small = None if by else small_table(usable.select("key_vec", "value_vec"), limit, "key_vec", "value_vec")
    if small is not None:
        keys = np.concatenate([null_keys, as_matrix(small.column("key_vec"), width, gaps=0.0)]) if small.num_rows else null_keys
        values = np.concatenate([null_values, as_matrix(small.column("value_vec"), null_values.shape[1], gaps=0.0)]) if small.num_rows else null_values
        shared = queries.sparkSession.sparkContext.broadcast((_directions(keys, heads), _heads(values, heads)))
        schema = T.StructType([queries.schema["query_id"], T.StructField("result", T.ArrayType(T.DoubleType()))])

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), result(states(directed(batch.column(1)), *shared.value))], schema.names)

        return queries.select("query_id", "vec").mapInArrow(look_up, schema)

    rows, usable = numbered(queries.select(*names)), cut_lineage(usable)
    fields = "_row bigint, peak array<double>, mass array<double>, acc array<double>"

    null = _directions(null_keys, heads), _heads(null_values, heads)

    def table(ids: pa.Array, found: list[np.ndarray]) -> pa.Table:
        return pa.table([ids, *map(as_vectors, found)], names=["_row", "peak", "mass", "acc"])

    def of_block(some: pa.Table, block: pa.Table, pieces: list[Piece]) -> pa.Table:
        mine, keys = directed(some.column("vec")), directed(block.column("key_vec"))
        values = _heads(as_matrix(block.column("value_vec"), null_values.shape[1], gaps=0.0), heads)
        found = [states(mine[at : at + n], keys[to : to + m], values[to : to + m]) for at, n, to, m in pieces]
        rows = some.column("_row").to_numpy()
        ids = np.concatenate([rows[at : at + n] for at, n, _, _ in pieces])
        return table(pa.array(ids), [np.concatenate(c) for c in zip(*found)])

    def of_null(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from table(batch.column(0), states(directed(batch.column(1)), *null)).to_batches()

    per_block = max(1, min(limit, BLOCK_BYTES) // rows_and_bytes(usable, "key_vec", "value_vec")[1])
    block = meet(rows.select("_row", *names[1:]), usable.withColumnRenamed("key_id", "_id"), per_block, per_block, of_block, fields, by)
    every = block.unionByName(rows.select("_row", "vec").mapInArrow(of_null, fields))
    merged = merged_runs(every, ["_row"], _merge, ["peak", "mass", "acc"], [])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), result([as_matrix(batch.column(i)) for i in (1, 2, 3)])], ["_row", "result"])

    done = merged.mapInArrow(finish, "_row bigint, result array<double>")
    return rows.join(done, "_row").select("query_id", "result")
