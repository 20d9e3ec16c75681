"""Summary statistics: count, mean and sum of squared deviations, which merge."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Summary:
    count: int = 0
    mean: float = 0.0
    deviations: float = 0.0

    def __add__(self, other: Summary) -> Summary:
        n = self.count + other.count
        if not n:
            return Summary()
        d = other.mean - self.mean
        return Summary(n, self.mean + d * other.count / n, self.deviations + other.deviations + d * d * self.count * other.count / n)

    @property
    def variance(self) -> float:
        """Of the population; NaN if there are no values."""
        return self.deviations / self.count if self.count else float("nan")

    @property
    def stddev(self) -> float:
        return self.variance**0.5

    @classmethod
    def of(cls, *values: float) -> Summary:
        return reduce(Summary.__add__, (Summary(1, float(v), 0.0) for v in values), cls())

    def __str__(self) -> str:
        return f"{self.mean:.4f} +/- {self.stddev:.4f} (n = {self.count})"


def summary(column: Column | str) -> list[Column]:
    """Aggregates n, mean, variance and stddev of the population; map-side partial and merging are Spark's own."""
    c = F.col(column) if isinstance(column, str) else column
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("stddev")]


def merged(parts: DataFrame) -> list[Column]:
    """Of rows n, mean, variance: the same of all rows behind them. Rows with n = 0 do not count."""
    n, mean = F.col("n"), F.col("mean")
    total = F.sum(n)
    whole = F.sum(n * mean) / total
    square = F.sum(n * (F.col("variance") + mean * mean)) / total
    return [total.alias("n"), whole.alias("mean"), (square - whole * whole).alias("variance")]
