"""Losses as one-row aggregates over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotgrid.functions.scalars import safe_div, safe_log, sigmoid
from spotgrid.operators.decoding import SAMPLE_KEYS, log_softmax
from spotgrid.operators.masking import IGNORE_INDEX

# Fixed value: upper bound of the adaptive generator weight.
MAX_ADAPTIVE_WEIGHT = 1e4


def recon_loss(pixels: DataFrame, recon: DataFrame, cells: Column | int, kind: str = "l1") -> DataFrame:
    """Mean difference over all ``cells`` of the dense images; absent pixels are zero.

    Both sides are summed per pixel by one aggregate over their union (the
    reconstruction with a minus sign), which needs no outer join.
    """
    if kind not in ("l1", "l2"):
        raise ValueError(f"unknown kind {kind!r}")
    keys = ["gene_idx", "px", "py"]
    real = pixels.select(*keys, F.col("value").cast("double").alias("value"))
    fake = recon.select(*keys, (-F.col("value").cast("double")).alias("value"))
    gap = real.unionByName(fake).groupBy(*keys).agg(F.sum("value").alias("d"))
    size = F.abs("d") if kind == "l1" else F.col("d") * F.col("d")
    count = cells if isinstance(cells, Column) else F.lit(cells)
    return gap.agg((F.coalesce(F.sum(size), F.lit(0.0)) / count).alias("loss"))


def hinge_discr(pairs: DataFrame) -> DataFrame:
    """Hinge loss of the critic over paired ``fake, real`` logits."""
    zero = F.lit(0.0)
    per_row = F.greatest(F.lit(1.0) + F.col("fake"), zero) + F.greatest(F.lit(1.0) - F.col("real"), zero)
    return pairs.agg(F.avg(per_row).alias("loss"))


def hinge_gen(fakes: DataFrame) -> DataFrame:
    """Hinge loss of the generator."""
    return fakes.agg((-F.avg("fake")).alias("loss"))


def bce_discr(pairs: DataFrame) -> DataFrame:
    """Log loss of the critic over paired ``fake, real`` logits."""
    per_row = -safe_log(F.lit(1.0) - sigmoid(F.col("fake")), "add") - safe_log(sigmoid(F.col("real")), "add")
    return pairs.agg(F.avg(per_row).alias("loss"))


def bce_gen(fakes: DataFrame) -> DataFrame:
    """Log loss of the generator."""
    return fakes.agg((-F.avg(safe_log(sigmoid(F.col("fake")), "add"))).alias("loss"))


def masked_cross_entropy(
    logits: DataFrame, labels: DataFrame, ignore_index: int = IGNORE_INDEX, keys: tuple[str, ...] = SAMPLE_KEYS
) -> DataFrame:
    """Mean cross entropy over positions whose label is not ignored.

    ``labels`` has the ``keys`` and ``label``; equal labels of a distribution are counted
    before they meet it, so a distribution shared by most samples is one row.  A label
    without a logit row has probability zero, so its loss is infinite.
    """
    wanted = labels.where(F.col("label") != ignore_index).select(*keys, "label")
    counted = wanted.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    at = log_softmax(logits, keys).withColumnRenamed("token_id", "label")
    joined = counted.join(at, [*keys, "label"], "left")
    total = F.sum(F.coalesce(-F.col("logp"), F.lit(float("inf"))) * F.col("_n"))
    return joined.agg((total / F.sum("_n")).alias("loss"))


def bce_with_logits(rows: DataFrame) -> DataFrame:
    """Mean log loss of ``logit`` against a 0/1 ``label``, in the stable form."""
    z, y = F.col("logit"), F.col("label")
    return rows.agg(F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))).alias("loss"))


def feature_mse(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Mean squared difference over all elements of paired ``vec`` columns."""
    joined = a.select(key, F.col("vec").alias("_a")).join(b.select(key, F.col("vec").alias("_b")), key)
    squares = F.zip_with("_a", "_b", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    return joined.agg((F.sum(total) / F.sum(F.size("_a"))).alias("loss"))


def adaptive_weight(num: Column, den: Column) -> Column:
    """Ratio of two gradient norms, floored divisor, bounded above."""
    return F.least(safe_div(num, den), F.lit(MAX_ADAPTIVE_WEIGHT))


def combined_loss(terms: DataFrame, group: list[str], weight: str = "weight", value: str = "value") -> DataFrame:
    """Weighted sum of loss terms ``(*group, value, weight)`` per group."""
    return terms.groupBy(*group).agg(F.sum(F.col(value) * F.col(weight)).alias("loss"))
