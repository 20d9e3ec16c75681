"""Building indices from vectors, as one call."""

from __future__ import annotations

import logging
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.functions.vectors import normalize
from lodevec.operators import index, kmeans, pq

log = logging.getLogger("lodevec")


def default_partitions(vectors: int) -> int:
    return max(1, vectors // 1000)


def default_limit(partitions: int) -> int:
    return max(partitions // 20, 5)


def spread(vectors: DataFrame) -> DataFrame:
    """vectors in equal parts, one for each core at least: training passes over them many times, each time as long as its
    longest task."""
    return vectors.repartition(max(vectors.rdd.getNumPartitions(), vectors.sparkSession.sparkContext.defaultParallelism))


class Progress(Protocol):
    def __call__(self, task: str, done: int, total: int, note: str = "") -> None: ...


def build(vectors: DataFrame, metric: str = "l2", clusters: int = 256, sections: int = 25, iterations: int = 100, partitioned: bool = False, partitions: int | None = None, limit: int | None = None, path: str | None = None, progress: Progress | None = None) -> index.FlatPQIndex | index.IVFPQIndex:
    """vectors: key, vector. Cosine indices are built of unit vectors. Training passes over the vectors (or
    their residuals) once a round, so they are spread evenly and kept in memory and on disk meanwhile. With a path the index is saved there, what was kept is let go, and the
    index returned is the saved one, whose queries read only what they probe; otherwise it encodes vectors when asked, and
    what is kept stays."""
    if not 1 <= clusters <= 1 << 16:
        raise ValueError("clusters must be 1 to 65536")
    if not partitioned and (partitions or limit):
        raise ValueError("partitions and limit are for partitioned indices")
    tell = progress or (lambda task, done, total, note="": log.debug("%s: %d of %d %s", task, done, total, note))

    def of_kmeans(r: kmeans.Report) -> None:
        tell("partitions", r.most + 1 if r.converged else r.iteration + 1, r.most + 1, f"steps {r.step_mean:.3g} +/- {r.step_stddev:.3g}")

    def of_pq(r: pq.Report) -> None:
        tell("quantizer", r.done, r.sections, f"round {r.iteration + 1} of {r.most + 1}, steps {r.step.mean:.3g} +/- {r.step.stddev:.3g}")

    if metric == "cosine":
        vectors = vectors.withColumn("vector", normalize(F.col("vector")))
    held = [spread(vectors.select("key", "vector")).persist(StorageLevel.MEMORY_AND_DISK)]
    if not partitioned:
        log.info("training the quantizer")
        found = index.FlatPQIndex.build(held[0], pq.train(held[0], sections, clusters, iterations, report=of_pq), metric)
    else:
        n = partitions or default_partitions(held[0].count())
        log.info("clustering into %d partitions", n)
        coarse = kmeans.train(held[0], n, iterations, report=of_kmeans)
        # Of the vectors as they are spread: grouped() lays out small tables as a single task's work.
        apart = coarse.assign(held[0], "partition").select("partition", "key", "vector")
        held.append(index.residuals(apart, coarse).persist(StorageLevel.MEMORY_AND_DISK))
        log.info("training the quantizer on residuals")
        quantizer = pq.train(held[1], sections, clusters, iterations, report=of_pq)
        held.append(index.grouped(held[0], coarse).persist(StorageLevel.MEMORY_AND_DISK))
        found = index.IVFPQIndex.build(held[2], quantizer, coarse, metric, index.LimitGroups(limit or default_limit(n)))
    if path is None:
        return found
    log.info("writing the index")
    found.save(path)
    for df in held:
        df.unpersist()
    return index.load(vectors.sparkSession, path)
