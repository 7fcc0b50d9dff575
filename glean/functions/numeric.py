
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column) -> Column:
    """MA1: 0 where the divisor is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """MA4: similarity of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """MA6: 0 if either vector is zero."""
    return safe_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rounded(c: Column, digits: int, mode: str = "half_up") -> Column:
    """PRJ10: ``half_up``, or ``half_even`` as in NumPy."""
    if mode not in ("half_up", "half_even"):
        raise ValueError(f"unknown rounding {mode!r}")
    return F.round(c, digits) if mode == "half_up" else F.bround(c, digits)


def clip01(c: Column) -> Column:
    """PRJ11."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def argmax_place(values: Column) -> Column:
    """WN10: 0-based place of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1


def close_to(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """MA12."""
    return F.abs(a - b) <= tolerance
