"""Scalar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floors used by the logs and the division.
LOG_FLOOR = 1e-20
LOG_SHIFT = 1e-10
DIV_FLOOR = 1e-8


def clamp(value: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL and NaN stays NaN."""
    clipped = F.greatest(F.least(value, F.lit(float(hi))), F.lit(float(lo)))
    return F.when(value.isNotNull(), F.when(F.isnan(value), value.cast("double")).otherwise(clipped))


def dim_divisor(layers: int | Column) -> Column:
    """Pixels per grid cell side: two to the number of layers."""
    return F.pow(F.lit(2), _int(layers)).cast("int")


def fmap_size(image_size: int | Column, layers: int | Column) -> Column:
    """Grid cells per side after halving ``layers`` times."""
    return F.floor(_int(image_size) / dim_divisor(layers)).cast("int")


def _int(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def grid_side(image_size: int, layers: int) -> int:
    """Driver-side form of :func:`fmap_size`, refusing sizes that do not divide."""
    if layers < 0 or image_size % (1 << layers):
        raise ValueError(f"image size {image_size} is not a multiple of {1 << layers}")
    return image_size >> layers


def cosine_schedule(t: Column) -> Column:
    """Share of positions still hidden at time ``t`` in [0, 1]."""
    return F.cos(t * F.lit(math.pi) * F.lit(0.5))


def safe_log(x: Column, mode: str = "clamp") -> Column:
    """Natural log that never sees zero: floor the input or shift it."""
    if mode == "clamp":
        return F.log(F.greatest(x, F.lit(LOG_FLOOR)))
    if mode == "add":
        return F.log(x + F.lit(LOG_SHIFT))
    raise ValueError(f"unknown mode {mode!r}")


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` with the divisor floored."""
    return a / F.greatest(b, F.lit(DIV_FLOOR))


def flatten_pos(row: Column, col: Column, width: int) -> Column:
    """Row-major position of a grid cell."""
    return (row * F.lit(width) + col).cast("int")


def unflatten_pos(pos: Column, width: int) -> tuple[Column, Column]:
    """Grid row and column of a row-major position."""
    row = F.floor(pos / F.lit(width)).cast("int")
    return row, (pos % F.lit(width)).cast("int")


def where_masked(mask: Column, a: Column, b: Column) -> Column:
    """``a`` where the mask is true, ``b`` elsewhere (NULL counts as false)."""
    return F.when(mask, a).otherwise(b)


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
