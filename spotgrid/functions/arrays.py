"""Array column functions on vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Norm floor and variance floor.
NORM_FLOOR = 1e-12
VARIANCE_FLOOR = 1e-5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside a lambda body.

    Spark does not share sub-expressions inside lambdas, so a norm used for
    every element would otherwise be recomputed per element.
    """
    return F.transform(F.array(value), body)[0]


def known(vec: Column) -> Column:
    """The vector with missing components (null or NaN) as zero."""
    return F.transform(vec, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0).cast("double")).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vec: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(vec, vec))


def l2_normalize(vec: Column) -> Column:
    """Unit-length vector; the zero vector stays zero."""
    floor = F.lit(NORM_FLOOR)
    return let(F.greatest(l2_norm(vec), floor), lambda n: F.transform(vec, lambda x: x.cast("double") / n))


def vector_mean(vec: Column) -> Column:
    """Mean of the elements."""
    total = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.size(vec)


def layer_norm(vec: Column, gamma: Column | None = None, mode: str = "add", eps: float = VARIANCE_FLOOR) -> Column:
    """Centre and scale by the biased standard deviation, then times ``gamma``.

    ``add`` adds eps to the variance, ``clamp`` floors the variance at eps.
    """
    if mode not in ("add", "clamp"):
        raise ValueError(f"unknown mode {mode!r}")

    def scaled(centred: Column) -> Column:
        var = dot(centred, centred) / F.size(centred)
        spread = F.sqrt(var + F.lit(eps) if mode == "add" else F.greatest(var, F.lit(eps)))
        return let(spread, lambda s: F.transform(centred, lambda x: x / s))

    centred = let(vector_mean(vec), lambda m: F.transform(vec, lambda x: x.cast("double") - m))
    normed = let(centred, scaled)
    if gamma is None:
        return normed
    return F.zip_with(normed, gamma, lambda x, g: x * g)


def any_nonzero(vec: Column) -> Column:
    """True if any element differs from zero."""
    return F.exists(vec, lambda x: x != 0)


def add_vectors(a: Column, b: Column) -> Column:
    """Element-wise sum."""
    return F.zip_with(a, b, lambda x, y: x + y)


def fill_gaps(entries: Column, size: int | Column, fill: Column) -> Column:
    """Dense array of ``size`` from an array of ``struct(pos, item)``.

    Entries are sorted by position and the gaps between neighbours are filled,
    which is linear in ``size`` (a map lookup per position would be quadratic).
    A repeated or out-of-range position raises.
    """
    length = size if isinstance(size, Column) else F.lit(size)

    def body(ordered: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ordered, i - 1)["pos"], F.lit(-1))
        runs = F.transform(
            ordered,
            lambda e, i: F.concat(F.array_repeat(fill, e["pos"] - before(i) - 1), F.array(e["item"])),
        )
        last = F.coalesce(F.get(ordered, F.size(ordered) - 1)["pos"], F.lit(-1))
        return F.concat(F.flatten(runs), F.array_repeat(fill, (length - last - 1).cast("int")))

    dense = let(F.sort_array(entries), body)
    message = F.lit("dense array: a position is repeated or out of range")
    return let(dense, lambda d: F.when(F.size(d) == length, d).otherwise(F.raise_error(message)))
