"""Broadcast only what is proven small.

Operators know some sizes by construction: a grid has ``image_size**2`` cells, a
codebook has ``k`` codes.  Such sides get a broadcast hint when the product of
rows and row width stays below the limit.  Every other join carries no hint:
Catalyst and adaptive execution then decide from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotgrid.plans.session import cut_lineage

BROADCAST_LIMIT = 128 * 1024 * 1024

# Rows of one key that one task may join, and the most keys that can have more than their share of all rows.
KEY_ROWS, HOT_KEYS = 1 << 20, 1 << 16


def fits(rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT) -> bool:
    """True if ``rows`` rows of ``row_bytes`` bytes may be broadcast."""
    return rows * row_bytes <= limit


def bounded(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Add a broadcast hint if the proven size allows it, else leave the join to Spark."""
    return F.broadcast(df) if fits(rows, row_bytes, limit) else df


def join_shared(rows: DataFrame, shared: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_LIMIT, key_rows: int = KEY_ROWS) -> DataFrame:
    """``rows`` joined with a table that many of them share, whatever the share of one key.

    The shared table is materialised and counted, and broadcast if it is small.
    Otherwise keys with more than ``key_rows`` rows are dealt over several salts, as
    many as their counts ask for, and the shared rows of these keys are copied to each
    salt.  At most ``HOT_KEYS`` keys can be that large, so their list is broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no shared join of kind {how!r}")
    shared = cut_lineage(shared)
    if fits(shared.count(), 32 + 16 * len(shared.columns), limit):
        return rows.join(F.broadcast(shared), on, how)
    dealt, copied = salted(rows, shared, on, key_rows)
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


def salted(rows: DataFrame, shared: DataFrame, on: list[str], key_rows: int = KEY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_salt``: keys of more than ``key_rows`` rows are dealt over several, their shared rows are in each."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    most = F.greatest(F.lit(key_rows), F.ceil(F.sum("_rows") / HOT_KEYS))
    bound = counts.agg(F.coalesce(most, F.lit(key_rows))).first()[0]
    hot = F.broadcast(cut_lineage(counts.where(F.col("_rows") > bound).select(*on, F.ceil(F.col("_rows") / bound).cast("int").alias("_salts"))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = rows.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    copied = shared.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt, copied
