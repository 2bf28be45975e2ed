"""Training metrics over time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotgrid.plans.session import cut_lineage

# Steps gathered in one group of the moving average.
BLOCK_STEPS = 1024


def accumulate_metrics(metrics: DataFrame, grad_accum: int) -> DataFrame:
    """Per step and key the sum of ``value / grad_accum``."""
    return metrics.groupBy("step", "key").agg(F.sum(F.col("value") / F.lit(grad_accum)).alias("value"))


def epoch_length(batch_size: int, batches: int, unit: str = "samples") -> int:
    """Steps until the epoch counter reaches the number of batches.

    With ``unit='samples'`` the counter grows by the batch size per step, with
    ``'batches'`` by one.
    """
    if unit not in ("samples", "batches"):
        raise ValueError(f"unknown unit {unit!r}")
    return math.ceil(batches / batch_size) if unit == "samples" else batches


def epoch_validation(losses: DataFrame, batch_size: int, batches: int, unit: str = "samples") -> DataFrame:
    """``(epoch, last_step, val_loss)`` from validation batch losses ``(step, value)``.

    Epochs count from 1 and close every ``epoch_length`` steps; steps after the
    last one that closed report nothing.  The validation loss is the plain mean
    over batch losses, so a short batch weighs as much.
    """
    period = epoch_length(batch_size, batches, unit)
    last = F.broadcast(losses.agg(F.max("step").alias("_last")))
    epoch = (F.floor(F.col("step") / F.lit(period)) + 1).cast("long")
    means = losses.groupBy(epoch.alias("epoch")).agg(F.avg("value").alias("val_loss"))
    closed = means.select("epoch", (F.col("epoch") * F.lit(period) - 1).alias("last_step"), "val_loss").crossJoin(last)
    return closed.where(F.col("last_step") <= F.col("_last")).drop("_last")


def ema_by_key(
    rows: DataFrame,
    key: str,
    order: str,
    value: str,
    beta: float,
    update_after: int = 0,
    update_every: int = 1,
    block: int = BLOCK_STEPS,
) -> DataFrame:
    """Exponential moving average per key in step order: ``(key, order, ema)``.

    ``order`` is an integer step, unique per key.  Only steps divisible by
    ``update_every`` update; up to ``update_after`` the value is copied; the
    first update copies too; other steps repeat the last average (NULL before
    the first).

    Every step is a linear map ``e -> a * e + b``.  Maps are composed inside blocks
    of ``block`` steps, then inside blocks of blocks, and so on until one block
    holds a key's whole range, so no group has more than ``block`` rows whatever a
    key's share is.
    """
    applied = F.pmod(F.col(order), F.lit(update_every)) == 0
    copied = F.col(order) <= F.lit(update_after)
    a = F.when(~applied, 1.0).when(copied, 0.0).otherwise(float(beta))
    b = F.when(~applied, 0.0).when(copied, F.col(value).cast("double")).otherwise((1.0 - beta) * F.col(value).cast("double"))
    ends = rows.agg(F.min(order), F.max(order)).first()
    low, top = (0, 0) if ends[0] is None else (int(ends[0]), int(ends[1]) - int(ends[0]))
    maps = rows.select(
        F.col(key).alias("_key"), (F.col(order).cast("long") - F.lit(low)).alias("_at"), a.alias("_a"), b.alias("_b")
    )
    start = rows.where(applied).groupBy(F.col(key).alias("_key")).agg(
        F.min(F.col(order).cast("long")).alias("_first"), F.min_by(F.col(value).cast("double"), F.col(order)).alias("_start")
    )
    before = _maps_before(maps, block, top)
    joined = before.join(start, "_key", "left")
    carried = F.col("_before_a") * F.col("_start") + F.col("_before_b")
    at = F.col("_at") + F.lit(low)
    ema = F.when(at >= F.col("_first"), F.col("_a") * carried + F.col("_b"))
    return joined.select(F.col("_key").alias(key), at.alias(order), ema.alias("ema"))


def _composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's map composed with all before it, by doubling spans."""
    span = 1
    while span < len(a):
        next_a, next_b = a.copy(), b.copy()
        next_a[span:] = a[span:] * a[:-span]
        next_b[span:] = a[span:] * b[:-span] + b[span:]
        a, b, span = next_a, next_b, span * 2
    return a, b


def _maps_before(maps: DataFrame, block: int, top: int) -> DataFrame:
    """``maps(_key, _at, _a, _b)`` with ``_before_a, _before_b``: all earlier maps of the key as one; ``_at`` is in 0 .. ``top``."""
    kinds = [*maps.schema.fields, *(T.StructField(n, T.DoubleType()) for n in ("_before_a", "_before_b"))]
    schema = T.StructType([*kinds, T.StructField("_block", T.LongType())])

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable")
        a, b = _composed(pdf["_a"].to_numpy(), pdf["_b"].to_numpy())
        return pdf.assign(_before_a=np.append(1.0, a[:-1]), _before_b=np.append(0.0, b[:-1]))[[f.name for f in schema.fields]]

    blocks = maps.withColumn("_block", F.floor(F.col("_at") / F.lit(block)).cast("long"))
    local = blocks.groupBy("_key", "_block").applyInPandas(inside, schema)
    if top < block:
        return local.drop("_block")
    local = cut_lineage(local)
    last = F.max_by(F.struct("_a", "_b", "_before_a", "_before_b"), "_at")
    totals = local.groupBy("_key", F.col("_block").alias("_at")).agg(last.alias("m")).select(
        "_key", "_at", (F.col("m._a") * F.col("m._before_a")).alias("_a"), (F.col("m._a") * F.col("m._before_b") + F.col("m._b")).alias("_b")
    )
    above = _maps_before(totals, block, top // block).select(
        "_key", F.col("_at").alias("_block"), F.col("_before_a").alias("_outer_a"), F.col("_before_b").alias("_outer_b")
    )
    joined = local.join(above, ["_key", "_block"])
    return joined.select(
        "_key", "_at", "_a", "_b", (F.col("_before_a") * F.col("_outer_a")).alias("_before_a"),
        (F.col("_before_a") * F.col("_outer_b") + F.col("_before_b")).alias("_before_b"),
    )
