"""Randomness that depends on row keys only.

A draw is a function of (seed, keys), so it survives repartitioning, task
retries and re-reads, and the same number can be computed in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spotgrid.functions.scalars import safe_log

# Fixed value: number of distinct 32-bit draws.
DRAWS = 4294967296.0


def _text(part: str | int | float | Column) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    if isinstance(part, str):
        return F.col(part).cast("string")
    return F.lit(str(part))


def uniform(seed: int | Column, *keys: str | int | Column) -> Column:
    """Uniform draw in [0, 1) with 32 random bits, keyed by ``seed`` and ``keys``.

    Strings name columns.  Order on the draw needs the key as a tie-break.
    """
    text = F.concat_ws(":", *[_text(k) for k in (seed, *keys)])
    digits = F.substring(F.md5(text), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(DRAWS)


def gumbel_noise(u: Column) -> Column:
    """Gumbel(0, 1) noise from a uniform draw, with both logs floored."""
    return -safe_log(-safe_log(u))


def prob_mask(p: float, seed: int, *keys: str | int | Column) -> Column:
    """True with probability ``p``; 1 and 0 are exact and need no draw."""
    if p >= 1:
        return F.lit(True)
    if p <= 0:
        return F.lit(False)
    return uniform(seed, *keys) < F.lit(float(p))
