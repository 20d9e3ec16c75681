"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is one aggregation (the smallest neighbour of each node, with map-side combining), which is written down, and one
join of the links with it. Both sides of the join are plain exchanges, so Spark splits what a node with very many links
has; the number of rounds grows with the logarithm of the nodes. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = staged(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: u, v -> node, root: the smallest node of its component, for every node but the roots themselves."""
    now = staged(links.select("u", "v").where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        new = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(new) == mark or not new["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(new)
        now = staged(_small_star(staged(_large_star(now), "large-star")), "links")
