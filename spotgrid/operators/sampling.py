"""Exact random order, splits and batches without a one-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotgrid.functions.keyed import uniform
from spotgrid.plans.sizing import bounded

# Rows of one bucket of draws, which one task orders, and buckets whose offsets are added up together.
BUCKET_ROWS, FINE_BUCKETS = 1 << 16, 1024

# Hold-out share and seed.
VALID_FRAC = 0.05
SPLIT_SEED = 3407


def buckets_of(rows: int) -> int:
    """Buckets of draws for so many rows."""
    return max(1, -(-rows // BUCKET_ROWS))


def random_ranks(
    df: DataFrame, key: str, seed: int, epoch: str | Column | None = None, buckets: int | None = None, most: Column | None = None
) -> DataFrame:
    """Add the exact 0-based ``rank`` of every row in random order, and ``total``.

    The order is by (draw, key).  Each row falls in the bucket of its draw; its
    rank is the number of rows in lower buckets plus its rank inside the bucket.
    Since draws are uniform, one hash shuffle on the bucket spreads any data
    evenly.  The number of buckets follows from a count of the rows, unless given;
    a table that fits one bucket is ordered at once.  Offsets are added up in two
    levels, so that no task sees more than a share of the buckets.  With ``epoch`` (a
    column of ``df``), every epoch is ordered on its own.  With ``most``, an expression
    over ``epoch`` and ``total``, buckets that begin at that rank or later are left out
    before anything is ordered.
    """
    group = [] if epoch is None else ["epoch"]
    if buckets is None:
        buckets = buckets_of(df.count())
    source = df if epoch is None else df.withColumn("epoch", F.col(epoch) if isinstance(epoch, str) else epoch)
    kept = [c for c in source.columns if c not in group]
    drawn = source.withColumn("_draw", uniform(seed, *group, key))
    if buckets == 1:
        whole = Window.partitionBy(*(group or [F.lit(0)]))
        rank = F.row_number().over(whole.orderBy("_draw", key)).cast("long") - 1
        return drawn.select(*group, *kept, rank.alias("rank"), F.count(F.lit(1)).over(whole).alias("total"))
    drawn = drawn.withColumn("_bucket", F.coalesce(F.floor(F.col("_draw") * F.lit(buckets)).cast("long"), F.lit(0).cast("long")))
    offsets = _bucket_offsets(drawn, group)
    if most is not None:
        offsets = offsets.where(F.col("_offset") < most)
    if not group:
        offsets = bounded(offsets, buckets, 48)

    inside = Window.partitionBy(*group, "_bucket").orderBy("_draw", key)
    joined = drawn.join(offsets, [*group, "_bucket"]).withColumn("_inside", F.row_number().over(inside) - 1)
    rank = (F.col("_offset") + F.col("_inside")).cast("long")
    return joined.select(*group, *kept, rank.alias("rank"), F.col("total").cast("long").alias("total"))


def _bucket_offsets(drawn: DataFrame, group: list[str]) -> DataFrame:
    """``(*group, _bucket, _offset, total)``: rows in lower buckets, and in all."""
    coarse = F.floor(F.col("_bucket") / FINE_BUCKETS)
    sizes = drawn.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size")).withColumn("_coarse", coarse)
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.groupBy(*group, "_coarse").agg(F.sum("_size").alias("_sum"))
    starts = sums.select(*group, "_coarse", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(whole).alias("total"))
    lower = Window.partitionBy(*group, "_coarse").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    fine = sizes.withColumn("_inner", F.coalesce(F.sum("_size").over(lower), F.lit(0)))
    return fine.join(starts, [*group, "_coarse"]).select(*group, "_bucket", (F.col("_start") + F.col("_inner")).alias("_offset"), "total")


def exact_split(df: DataFrame, key: str, valid_frac: float = VALID_FRAC, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``split``: exactly ``int((1 - valid_frac) * n)`` rows train, the rest valid.

    With ``valid_frac = 0`` both sets are the whole table, so every row appears twice.
    """
    if valid_frac == 0:
        return df.withColumn("split", F.explode(F.array(F.lit("train"), F.lit("valid"))))
    train_size = (F.lit(1.0 - valid_frac) * F.col("total")).cast("long")
    split = F.when(F.col("rank") < train_size, F.lit("train")).otherwise(F.lit("valid"))
    return random_ranks(df, key, seed).select(*df.columns, split.alias("split"))


def shuffle_batches(df: DataFrame, key: str, batch_size: int, epoch: int = 0, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``batch_id`` and ``slot`` in the random order of one epoch; a short last batch stays."""
    ranked = random_ranks(df, key, seed, epoch=F.lit(epoch))
    return ranked.select(*df.columns, *_batch_columns(batch_size))


def _batch_columns(batch_size: int) -> list[Column]:
    batch = F.floor(F.col("rank") / F.lit(batch_size)).cast("long")
    slot = (F.col("rank") % F.lit(batch_size)).cast("int")
    return [batch.alias("batch_id"), slot.alias("slot")]


def cycle_batches(
    df: DataFrame, key: str, batch_size: int, steps: int, grad_accum: int = 1, seed: int = SPLIT_SEED
) -> DataFrame:
    """Rows consumed by each of ``steps`` steps of ``grad_accum`` consecutive batches.

    The data is reused pass after pass with a new order each time.  Only the
    passes the steps need are made; their number comes from a count.
    """
    needed = steps * grad_accum
    n = df.count()
    batches = -(-n // batch_size)
    passes = F.sequence(F.lit(0), F.lit(-(-needed // max(1, batches)) - 1))
    reused = df.withColumn("_pass", F.explode(passes))
    # The last pass is rarely used up; its later buckets are never ordered.
    most = (F.lit(needed) - F.col("epoch").cast("long") * batches) * F.lit(batch_size)
    ranked = random_ranks(reused, key, seed, epoch="_pass", buckets=buckets_of(n), most=most).select(
        "epoch", *df.columns, *_batch_columns(batch_size)
    )
    position = F.col("epoch").cast("long") * batches + F.col("batch_id")
    step = F.floor(position / F.lit(grad_accum)).cast("long")
    return (
        ranked.where(position < F.lit(needed))
        .withColumn("step", step)
        .select("step", "epoch", "batch_id", "slot", *df.columns)
    )
