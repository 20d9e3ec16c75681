"""How good an index's answers are: sampled queries, exact truth, recall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.functions.vectors import distance_sq, normalize
from lodevec.operators import knn
from lodevec.operators.kmeans import numbered
from lodevec.operators.rng import sample_rows

# The neighbour counts at which recall is reported.
KS = (1, 2, 3, 5, 10, 25, 50, 100, 500, 1000)


def sample(vectors: DataFrame, n: int = 1000, seed: int = 0, order: str = "key") -> DataFrame:
    """query_id (0 .. n - 1), vector: rows drawn with replacement by java.util.Random from the order of a column."""
    spark, size = vectors.sparkSession, vectors.count()
    picks = sample_rows(size, n, seed) if size else []
    drawn = F.broadcast(spark.createDataFrame(list(enumerate(picks)), "query_id long, row_id long"))  # n rows
    return numbered(vectors, order).join(drawn, "row_id").select("query_id", "vector")


def truth(queries: DataFrame, vectors: DataFrame, ks: tuple[int, ...] = KS, metric: str = "l2") -> DataFrame:
    """query_id, k, max_dist_sq: the distance of the kth nearest vector, for each k that there are vectors for."""
    near = knn.exact(queries, vectors, max(ks), metric)
    return near.where(F.col("rank").isin(*ks)).select("query_id", F.col("rank").alias("k"), F.col("distance").alias("max_dist_sq"))


def recall(results: DataFrame, queries: DataFrame, vectors: DataFrame, truths: DataFrame, epsilon: float = 0.0, metric: str = "l2") -> DataFrame:
    """results: query_id, rank, key -> k, n, mean, stddev (population) of recall at each k of truths.

    A result counts if its exact distance is at most the kth true one, enlarged by epsilon. Keys are to be unique; a result
    whose key has no vector is an error.
    """
    if epsilon < 0:
        raise ValueError("epsilon must not be negative")
    unit = normalize if metric == "cosine" else lambda v: v
    exact = results.join(vectors.select("key", F.col("vector").alias("v"), F.lit(True).alias("known")), "key", "left").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    lost = F.raise_error(F.concat(F.lit("no vector for the result "), F.col("key").cast("string")))
    exact = exact.select("query_id", "rank", F.when(F.col("known").isNull(), lost).otherwise(distance_sq(unit(F.col("v")), unit(F.col("q")))).alias("d"))
    cutoff = F.when(F.lit(epsilon) == 0, F.col("max_dist_sq")).otherwise(F.pow(F.sqrt("max_dist_sq") * (1 + epsilon), 2))
    hit = (F.col("d") <= cutoff + 1e-12) & (F.col("rank") <= F.col("k"))
    per = truths.join(exact, "query_id", "left").groupBy("query_id", "k").agg((F.count_if(hit) / F.col("k")).alias("recall"))
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("mean"), F.stddev_pop("recall").alias("stddev"))


def lines(recalls: DataFrame) -> DataFrame:
    """k and the line that tells of it."""
    return recalls.select("k", F.format_string("R@%d: %.4f +/- %.4f", "k", "mean", "stddev").alias("line"))


def report(recalls: DataFrame, tell: Callable[[str], None] = print) -> None:
    for r in lines(recalls).orderBy("k").collect():  # a row for each k
        tell(r["line"])
