"""Vector quantisation with cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotgrid.functions.arrays import any_nonzero, fill_gaps, known, l2_normalize
from spotgrid.functions.keyed import uniform
from spotgrid.functions.scalars import flatten_pos, grid_side, unflatten_pos
from spotgrid.operators.meeting import BLOCK_BYTES, Piece, as_matrix, meet, numbered, rows_and_bytes, small_table
from spotgrid.operators.raster import patch_vectors, unpatch
from spotgrid.operators.vector_sums import sum_vectors
from spotgrid.plans.session import cut_lineage
from spotgrid.plans.sizing import BROADCAST_LIMIT, bounded

# Default number of codes and decay of the moving average.
CODES = 512
DECAY = 0.8

# Rounds of the fit, at most.
ROUNDS = 20

# Similarities are compared at this many digits, so that equal directions tie
# (and the lowest id wins) whatever the order of summation was.
TIE_DIGITS = 9

# Elements of one similarity block in a task: 2 MB, which stay in the cache while they are rounded.
BLOCK_ELEMENTS = 1 << 18


def fit_codebook(vectors: DataFrame, k: int = CODES, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Learn ``codebook(code_id, vec)`` by k-means under cosine distance.

    Code 0 is the blank code for zero vectors, which have no direction; codes
    1 .. k-1 are the plain means of their members, so decoding keeps the scale.
    The start is the ``k - 1`` vectors with the lowest draws of their key, which is
    all columns but ``vec``; a code without members stays as it is, and the rounds
    end early once no code moves.  Equal input gives equal codes on any cluster.
    """
    if k < 3:
        raise ValueError("a codebook needs the blank code and two more")
    keys = [c for c in vectors.columns if c != "vec"]
    usable = cut_lineage(vectors.withColumn("vec", known(F.col("vec"))).where(any_nonzero(F.col("vec"))))
    drawn = usable.select(uniform(seed, *keys).alias("_draw"), *keys, "vec").orderBy("_draw", *keys, "vec").limit(k - 1)
    numbered = drawn.withColumn("code_id", F.row_number().over(Window.orderBy("_draw", *keys, "vec")))  # k - 1 rows
    codes = cut_lineage(numbered.select(F.col("code_id").cast("int").alias("code_id"), "vec"))
    for _ in range(rounds):
        held: list = []
        sums = code_sums(assign_codes(usable.select("vec"), codes, held=held))
        means = sums.select("code_id", F.transform("total", lambda x: x / F.col("n")).alias("mean"))
        moved = cut_lineage(codes.join(means, "code_id", "left").select("code_id", F.coalesce("mean", "vec").alias("vec"), F.col("vec").alias("old")))
        for broadcast in held:
            broadcast.destroy()
        codes = moved.select("code_id", "vec")
        if not moved.where(F.col("vec") != F.col("old")).limit(1).count():
            break
    blank = codes.limit(1).select(F.lit(0).alias("code_id"), F.transform("vec", lambda x: F.lit(0.0).cast("double")).alias("vec"))
    return blank.unionByName(codes)


def code_sums(members: DataFrame) -> DataFrame:
    """``(code_id, n, total)``: count and element-wise sum of the member vectors; missing components count as zero, null vectors are no members."""
    return sum_vectors(members.withColumn("vec", known(F.col("vec"))), "code_id")


def assign_codes(
    vectors: DataFrame, codebook: DataFrame, limit: int = BROADCAST_LIMIT, held: list | None = None
) -> DataFrame:
    """Add ``code_id`` and ``sim``: the code with the highest cosine similarity, ties to the lowest id.

    A missing component (null or NaN) counts as zero; a null vector has no direction
    and takes the lowest code, the blank one of :func:`fit_codebook`.  Vectors of
    another length than the codes raise.

    All pairs are inherent here, so they run as matrix products over Arrow batches.
    A codebook of at most ``limit`` bytes is broadcast.  Of a larger one, blocks of
    codes meet blocks of vectors on executors, and the best code per block is merged
    by row.  ``held`` collects the broadcast for a caller that releases it once the
    result is materialised.
    """
    names = vectors.columns
    codes = codebook.select("code_id", "vec")
    small = small_table(codes, limit, "vec")
    if small is None:
        return _assign_blocks(vectors, codes, limit)
    ids, units = _units(small)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, units))
    if held is not None:
        held.append(shared)
    schema = T.StructType(
        [*vectors.schema.fields, T.StructField("code_id", T.IntegerType()), T.StructField("sim", T.DoubleType())]
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = shared.value
        for batch in batches:
            code, sim = _best_codes(batch.column(names.index("vec")), ids, units)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.int32()), pa.array(sim)], [*names, "code_id", "sim"])

    return vectors.mapInArrow(best, schema)


def _units(codes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ascending ids and their vectors of unit length, as columns."""
    ids, matrix = codes.column("code_id").to_numpy(), as_matrix(codes.column("vec"), gaps=0.0)
    order = np.argsort(ids, kind="stable")
    matrix = matrix[order]
    return ids[order].astype(np.int32), (matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)), 1e-12)).T.copy()


def _best_codes(vectors: pa.Array, ids: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code with the highest similarity, and that similarity, per vector; ties to the lowest id."""
    n = len(vectors)
    code, sim = np.zeros(n, dtype=np.int32), np.zeros(n)
    if not len(ids):
        raise ValueError("the codebook is empty")
    vecs = as_matrix(vectors, units.shape[0], gaps=0.0) if n else np.zeros((0, units.shape[0]))
    vecs = vecs / np.maximum(np.sqrt((vecs * vecs).sum(axis=1, keepdims=True)), 1e-12)
    step = max(1, BLOCK_ELEMENTS // units.shape[1])
    for at in range(0, n, step):
        scores = vecs[at : at + step] @ units
        np.round(scores, TIE_DIGITS, out=scores)
        scores += 0.0
        pick = scores.argmax(axis=1)
        code[at : at + step], sim[at : at + step] = ids[pick], scores[np.arange(len(pick)), pick]
    return code, sim


def _assign_blocks(vectors: DataFrame, codes: DataFrame, limit: int) -> DataFrame:
    """:func:`assign_codes` with a codebook that is not broadcast."""
    rows = numbered(vectors)
    per_block = max(1, min(limit, BLOCK_BYTES) // rows_and_bytes(codes, "vec")[1])

    def best(some: pa.Table, block: pa.Table, pieces: list[Piece]) -> pa.Table:
        rows, found = some.column("_row"), []
        for at, n, to, m in pieces:
            code, sim = _best_codes(some.column("vec").slice(at, n).combine_chunks(), *_units(block.slice(to, m)))
            found.append(pa.table({"_row": rows.slice(at, n), "sim": pa.array(sim), "code_id": pa.array(code, pa.int32())}))
        return pa.concat_tables(found)

    right = codes.select(F.col("code_id").alias("_id"), "code_id", "vec")
    found = meet(rows.select("_row", "vec"), right, per_block, per_block, best, "_row bigint, sim double, code_id int")
    top = found.groupBy("_row").agg(F.max(F.struct("sim", (-F.col("code_id")).alias("minus"))).alias("top"))
    return rows.join(top, "_row").select(*vectors.columns, (-F.col("top.minus")).cast("int").alias("code_id"), F.col("top.sim").alias("sim"))


def _codes(codebook: DataFrame, codes: int | None, dim: int | None) -> DataFrame:
    """Codebook side of a join by id; broadcast if the given size proves it small."""
    side = codebook.select("code_id", F.col("vec").alias("code_vec"))
    if codes is None or dim is None:
        return side
    return bounded(side, codes, 8 * dim + 64)


def commitment_loss(
    assigned: DataFrame, codebook: DataFrame, weight: float = 1.0, codes: int | None = None, dim: int | None = None
) -> DataFrame:
    """One row ``loss``: weighted mean squared difference between vectors and their codes."""
    joined = assigned.select("code_id", "vec").join(_codes(codebook, codes, dim), "code_id")
    squares = F.zip_with("vec", "code_vec", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.sum(total) / F.sum(F.size("vec"))
    return joined.agg((F.lit(float(weight)) * mean).alias("loss"))


def ema_update(state: DataFrame, assigned: DataFrame, decay: float = DECAY, normalize: bool = False) -> DataFrame:
    """Moving-average step on ``state(code_id, n, total)``; returns it with ``vec``.

    Counts and sums decay and take in the new members; a code without members
    only decays.  ``normalize`` scales the code to unit length.
    """
    fresh = code_sums(assigned).select("code_id", F.col("n").alias("new_n"), F.col("total").alias("new_total"))
    keep, add = F.lit(float(decay)), F.lit(1.0 - decay)
    n = keep * F.col("n") + add * F.coalesce("new_n", F.lit(0))
    blended = F.zip_with("total", "new_total", lambda old, new: keep * old + add * new)
    decayed = F.transform("total", lambda old: keep * old)
    joined = state.join(fresh, "code_id", "left").select(
        "code_id", n.alias("n"), F.when(F.col("new_total").isNull(), decayed).otherwise(blended).alias("total")
    )
    vec: Column = F.transform("total", lambda x: x / F.greatest("n", F.lit(1e-12)))
    return joined.select("code_id", "n", "total", (l2_normalize(vec) if normalize else vec).alias("vec"))


def decode_from_ids(
    tokens: DataFrame, codebook: DataFrame, codes: int | None = None, dim: int | None = None
) -> DataFrame:
    """``(sample_id, pos, vec)``: the code vector of every token."""
    side = _codes(codebook, codes, dim).withColumnRenamed("code_id", "token_id")
    return tokens.join(side, "token_id").select("sample_id", "pos", F.col("code_vec").alias("vec"))


def tokenize(
    pixels: DataFrame, codebook: DataFrame, image_size: int, layers: int, samples: DataFrame | None = None
) -> DataFrame:
    """Images to ``tokens(sample_id, pos, token_id)``, one per grid cell.

    Only blocks that hold a pixel are compared; all others have no direction and
    take the lowest code id, the blank code of :func:`fit_codebook`.  With
    ``samples(sample_id)`` every sample of that table has tokens, blank images too.
    """
    side = grid_side(image_size, layers)
    assigned = assign_codes(patch_vectors(pixels, image_size, layers), codebook)
    seen = assigned.select(
        F.col("gene_idx").cast("long").alias("sample_id"),
        flatten_pos(F.col("prow"), F.col("pcol"), side).alias("pos"),
        F.col("code_id").alias("token_id"),
    )
    blank = F.broadcast(codebook.agg(F.min("code_id").alias("blank")))
    return fill_positions(seen, side * side, blank, samples)


def fill_positions(seen: DataFrame, seq_len: int, blank: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Complete every sample (of ``samples``, if given) to ``seq_len`` positions with the one-row ``blank`` token."""
    entry = F.struct(F.col("pos").alias("pos"), F.col("token_id").alias("item"))
    grouped = seen.groupBy("sample_id").agg(F.collect_list(entry).alias("entries"))
    if samples is not None:
        every = samples.select(F.col("sample_id").cast("long").alias("sample_id")).distinct()
        grouped = every.join(grouped, "sample_id", "left")
    none = F.array().cast("array<struct<pos:int,item:int>>")
    filled = grouped.crossJoin(blank).withColumn("entries", F.coalesce("entries", none))
    dense = fill_gaps(F.col("entries"), seq_len, F.col("blank"))
    return filled.select("sample_id", F.posexplode(dense).alias("pos", "token_id"))


def detokenize(
    tokens: DataFrame, codebook: DataFrame, image_size: int, layers: int, codes: int | None = None
) -> DataFrame:
    """Tokens back to sparse pixels."""
    side = grid_side(image_size, layers)
    row, col = unflatten_pos(F.col("pos"), side)
    vectors = decode_from_ids(tokens, codebook, codes, 1 << (2 * layers))
    patches = vectors.select(F.col("sample_id").alias("gene_idx"), row.alias("prow"), col.alias("pcol"), "vec")
    return unpatch(patches, layers)
