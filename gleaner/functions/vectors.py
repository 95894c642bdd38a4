"""Column functions over vectors: arrays of numbers, with sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def l2_normalized(v: Column, floor: float = 1e-8) -> Column:
    """Divided by the norm, or by `floor` if that is larger."""
    return scaled(v, 1 / F.greatest(norm(v), F.lit(floor)))


def cosine(a: Column, b: Column, floor: float | None = None) -> Column:
    """0 if either norm is 0. With `floor`, each norm is raised by it instead."""
    if floor is not None:
        return dot(a, b) / ((norm(a) + floor) * (norm(b) + floor))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def fit_score(x: Column, mean: Column, std: Column) -> Column:
    """1 at the mean down to 0 at four deviations; without deviation, 1 for equality alone."""
    return F.when(std == 0, (x == mean).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - F.abs((x - mean) / std) / 4))


def safe_div(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))
