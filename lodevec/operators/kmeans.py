"""Lloyd's k-means. A round is one pass over the vectors: tasks add up their rows per cluster, a few tasks add up those
sums, and the driver holds the centroids (k x dimension numbers) only."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.operators.arrays import fingerprint, hashes, matrix, nearest, summed
from lodevec.operators.rng import sample_rows


@dataclass
class Report:
    iteration: int
    most: int
    step_mean: float
    step_stddev: float
    converged: bool


@dataclass
class KMeans:
    centroids: np.ndarray  # k x dimension

    @property
    def k(self) -> int:
        return len(self.centroids)

    @property
    def dimension(self) -> int:
        return self.centroids.shape[1]

    def norms_sq(self) -> np.ndarray:
        return (self.centroids**2).sum(axis=1)

    def frame(self, spark) -> DataFrame:
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, "cluster int, centroid array<double>")

    def assign(self, vectors: DataFrame, column: str = "cluster") -> DataFrame:
        """vectors with cluster (the nearest; ties to the lowest) and distance (squared)."""
        c, at, names = self.centroids, vectors.columns.index("vector"), vectors.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                index, d = nearest(matrix(b.column(at), c.shape[1]), c)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.astype(np.int32)), pa.array(d)], [*names, column, "distance"])

        schema = ", ".join(f"`{n}` {t}" for n, t in vectors.dtypes) + f", `{column}` int, distance double"
        return vectors.mapInArrow(run, schema)


def initial(vectors: DataFrame, k: int, seed: int = 0, order: str = "key") -> KMeans:
    """k rows drawn with replacement, numbered in the order of a column."""
    n = vectors.count()
    if not n:
        raise ValueError("no vectors")
    picks = sample_rows(n, k, seed)
    rows = pick_rows(vectors, picks, order)
    return KMeans(np.array([rows[i] for i in picks], np.float64))


def pick_rows(vectors: DataFrame, picks: list[int], order: str = "key") -> dict[int, list[float]]:
    """The vectors at some places of the order; places are counted per range partition, so no task sees all rows."""
    placed = numbered(vectors.select(order, "vector"), order)
    wanted = vectors.sparkSession.createDataFrame([(p,) for p in sorted(set(picks))], "row_id long")
    found = placed.join(F.broadcast(wanted), "row_id", "left_semi").select("row_id", "vector").collect()
    placed.held.unpersist()
    return {r["row_id"]: r["vector"] for r in found}


def numbered(rows: DataFrame, order: str = "key") -> DataFrame:
    """rows with row_id: their place, from 0, in the order of a column (ties by any order). The rows are kept meanwhile, as
    attribute held of the result, for the caller to let go."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    ranged = ranged.persist()
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    base, total = [], 0
    for p in sorted(counts):
        base.append((p, total))
        total += counts[p]
    bases = F.broadcast(spark.createDataFrame(base or [(0, 0)], "_part int, _base long"))
    within = F.expr(f"row_number() OVER (PARTITION BY _part ORDER BY `{order}`)")
    out = ranged.withColumn("_n", within).join(bases, "_part").withColumn("row_id", F.col("_base") + F.col("_n") - 1).drop("_part", "_n", "_base")
    out.held = ranged
    return out


#: Tasks that add up what the others found; the driver gets as many rows.
GATHER = 4


def tally(vectors: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays that count makes of each task's batches, added up over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(count(batches))], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for one in b.column(0):
                found = pickle.loads(one.as_py())
                total = found if total is None else [x + y for x, y in zip(total, found, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sums"])

    parts = vectors.mapInArrow(run, "sums binary").repartition(GATHER).mapInArrow(add, "sums binary")
    total = count(iter(()))
    for r in parts.collect():  # at most GATHER rows
        total = [x + y for x, y in zip(total, pickle.loads(r["sums"]), strict=True)]
    return total


def sums(vectors: DataFrame, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Per cluster the sum and number of its vectors; a number that says which vector is in which cluster; the objective."""
    k, d = new.shape

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        total, many, who, objective = np.zeros((k, d)), np.zeros(k, np.int64), np.zeros(1, np.uint64), np.zeros(1)
        for b in batches:
            x = matrix(b.column(0), d)
            index, dist = nearest(x, new)
            total += summed(index, x, k)
            many += np.bincount(index, minlength=k)
            who += fingerprint(hashes(x), index)
            objective += dist.sum()
        return [total, many, who, objective]

    total, many, who, objective = tally(vectors.select("vector"), count)
    return total, many, int(who[0]), float(objective[0])


def means(total: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Centroids; an empty cluster's is the zero vector, which stays."""
    return total / np.maximum(many, 1)[:, None]


def step_size(old: np.ndarray, new: np.ndarray) -> tuple[float, float]:
    """Mean and population deviation of the squared distances that centroids moved."""
    d = ((old - new) ** 2).sum(axis=1)
    return float(d.mean()), float(d.std())


def iterate(vectors: DataFrame, model: KMeans, rounds: int) -> KMeans:
    """A fixed number of rounds."""
    c = model.centroids
    for _ in range(rounds):
        total, many, _, _ = sums(vectors, c)
        c = means(total, many)
    return KMeans(c)


def train(vectors: DataFrame, k: int, iterations: int = 100, seed: int = 0, order: str = "key", start: KMeans | None = None, report: Callable[[Report], None] | None = None) -> KMeans:
    """Until no vector changes its cluster, or after iterations + 1 updates."""
    c = (start or initial(vectors, k, seed, order)).centroids
    last, converged = None, False
    for i in range(iterations + 1):
        total, many, who, _ = sums(vectors, c)
        if converged := who == last:
            break
        new = means(total, many)
        if report:
            report(Report(i, iterations, *step_size(c, new), False))
        last, c = who, new
    if report:
        report(Report(i, iterations, 0.0, 0.0, converged))
    return KMeans(c)
