"""Exact nearest neighbours and top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodevec.functions.vectors import distance_sq, normalize
from lodevec.operators.arrays import CELLS, Best, keys_of, matrix, near_distances, unit

#: Queries that are answered together, at most, and numbers (of their vectors, or of the best kept for them) at most:
#: they are broadcast, and a task holds that much.
BLOCK, NUMBERS = 1 << 17, 1 << 22


def top_k(rows: DataFrame, by: list[str], k: int, order: list | None = None) -> DataFrame:
    """The k first rows of each group, numbered by rank from 1; ties of distance (to 9 places) by key."""
    order = order or [F.round("distance", 9), F.col("key")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int"))
    return ranked.where(F.col("rank") <= k)


def query_blocks(queries: DataFrame, k: int, block: int | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """ids and vectors of the queries (query_id, vector), in blocks of bounded size, streamed to the driver."""
    ids, held, size = [], [], block or BLOCK
    for r in queries.select("query_id", "vector").toLocalIterator(prefetchPartitions=True):
        if not ids and block is None:
            size = max(1, min(BLOCK, NUMBERS // max(k, len(r["vector"] or ()), 1)))
        ids.append(r["query_id"])
        held.append(r["vector"])
        if len(ids) == size:
            yield ids, np.array(held, np.float64)
            ids, held = [], []
    if ids:
        yield ids, np.array(held, np.float64)


def scan(vectors: DataFrame, columns: list[str], ids: list, q: np.ndarray, k: int, key_type: str, id_type: str, feed: Callable[[Best, np.ndarray, pa.RecordBatch], None]) -> DataFrame:
    """One pass over vectors: each task keeps its k best for each query, then the k best of all tasks are taken. q goes to
    the executors once, as a broadcast variable; feed is given it with each batch."""
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        best = Best(len(names), k)
        for batch in batches:
            feed(best, asked, batch)
        i, key, d = best.rows()
        for at in range(0, max(len(i), 1), 1 << 17):
            to = at + (1 << 17)
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in i[at:to]], arrow_type(id_type)), pa.array(key[at:to].tolist(), arrow_type(key_type)), pa.array(d[at:to], pa.float64())], ["query_id", "key", "distance"])

    found = vectors.select(*columns).mapInArrow(run, f"query_id {id_type}, key {key_type}, distance double")
    return top_k(found, ["query_id"], k).select("query_id", "rank", "key", "distance")


def together(parts: list[DataFrame], spark, id_type: str, key_type: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, key {key_type}, distance double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def types_of(queries: DataFrame, vectors: DataFrame) -> tuple[str, str]:
    return dict(vectors.dtypes)["key"], dict(queries.dtypes)["query_id"]


def exact(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", block: int | None = None) -> DataFrame:
    """queries: query_id, vector; vectors: key, vector -> query_id, rank, key, distance (squared).

    With metric "cosine" both sides are made unit length first, so the distance is 2 - 2 cos. Queries go in blocks (by
    their size, or of so many), each one pass over the vectors; a range of keys is a filter on vectors. Vectors with NaN
    (or zero ones, under cosine) are no one's neighbours.
    """
    key_type, id_type = types_of(queries, vectors)

    def feed(best: Best, q: np.ndarray, batch: pa.RecordBatch) -> None:
        x, keys = matrix(batch.column(1), q.shape[1]), keys_of(batch.column(0))
        x = unit(x) if metric == "cosine" else x
        step = max(1, CELLS // max(1, len(x)))
        for at in range(0, len(q), step):
            rows = np.arange(at, min(at + step, len(q)))
            best.add(rows, near_distances(q[rows], x, k, best.worst(rows)), keys)

    parts = [scan(vectors, ["key", "vector"], ids, unit(q) if metric == "cosine" else q, k, key_type, id_type, feed) for ids, q in query_blocks(queries, k, block)]
    return together(parts, queries.sparkSession, id_type, key_type)


def rerank(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """found: query_id, key (an index's candidates) -> query_id, rank, key, distance: the k best by exact distance.

    Keys of vectors and ids of queries are to be unique."""
    unit = normalize if metric == "cosine" else lambda v: v
    pairs = found.select("query_id", "key").join(vectors.select("key", F.col("vector").alias("v")), "key").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    exact = pairs.select("query_id", "key", distance_sq(unit(F.col("v")), unit(F.col("q"))).alias("distance"))
    return top_k(exact, ["query_id"], k).select("query_id", "rank", "key", "distance")
