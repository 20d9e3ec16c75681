"""Vector functions as Column expressions. Elements count in double precision; vectors may be of any numeric element type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def add(x: Column, y: Column) -> Column:
    return F.zip_with(doubles(x), doubles(y), lambda a, b: a + b)


def subtract(x: Column, y: Column) -> Column:
    return F.zip_with(doubles(x), doubles(y), lambda a, b: a - b)


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, a: s + a)


def distance_sq(x: Column, y: Column) -> Column:
    """Squared Euclidean distance; null if the lengths differ."""
    return _sum(F.zip_with(doubles(x), doubles(y), lambda a, b: (a - b) * (a - b)))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(distance_sq(x, y))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(x), lambda a: a * a)))


def normalize(x: Column) -> Column:
    """Unit length; every element of a zero vector becomes NaN."""
    n = norm(x)
    return F.transform(doubles(x), lambda a: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(a, n)))


def section(x: Column, begin: int, long: int) -> Column:
    """Elements begin .. begin + long - 1, counted from 0."""
    return F.slice(x, begin + 1, long)


def split_ranges(dimension: int, parts: int) -> list[tuple[int, int]]:
    """(begin, length) of near-equal sections: the first ones one longer. More parts than dimensions leaves empty ones."""
    if parts < 1:
        raise ValueError("parts must be positive")
    longest = -(-dimension // parts)
    full = parts - (longest * parts - dimension)
    sizes = [longest] * full + [max(longest - 1, 0)] * (parts - full)
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def equal(x: Column, y: Column) -> Column:
    """Whether two vectors have the same elements; NaN equals NaN, and a missing vector only another one."""
    return doubles(x).eqNullSafe(doubles(y))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of keyed vectors hold the same rows, repeated ones as often."""
    named = [t.groupBy("key", doubles(F.col("vector")).alias("vector")).agg(F.count(F.lit(1)).alias("n")) for t in (a, b)]
    return not named[0].exceptAll(named[1]).head(1) and not named[1].exceptAll(named[0]).head(1)
