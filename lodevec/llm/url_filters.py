"""URL filters: rules, and where no rule fits, trust and distrust that spread over the links between hosts.

Hosts of pages that a rule allows are trusted seeds, hosts of pages that a rule blocks are blocked seeds, each by the
share of its pages. Personalised PageRank carries trust along links and distrust against them (who links to the blocked
is suspect). A host is blocked if its distrust exceeds its trust by the threshold; hosts that neither reaches are allowed.

Links are the absolute addresses in a page's html, and a host's own tie to the host above it (m.news.example and
news.example vouch for each other). They are counted per pair of hosts before anything else, so a host with any number
of pages is one row for each host it links to.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import HEAVY, ascii_lower, staged, table, text_or_empty

# The rules of the query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DAMPING, TOLERANCE, STEPS_A_TABLE = 0.85, 1e-9, 4
#: Steps after which less than TOLERANCE of the mass still moves, on any graph; no limit, as far hosts take longer.
STEPS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: Links, and seeds, up to which the driver makes the steps.
SMALL = 200_000
#: Weight of the tie to the host above, in links; distrust minus trust above which a host is blocked.
TIE, MARGIN = 1.0, 0.0
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    return tuple(F.when(has, c).otherwise("") for c in (ascii_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in longest]
    name, verdict = (F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, vs, strict=True)), F.lit(None).cast("string")) for vs in ([h + p for h, p, _ in longest], [v for *_, v in longest]))
    return name, verdict


def links_of(pages: DataFrame) -> DataFrame:
    """host, html -> src, dst, n."""
    far = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(text_or_empty("html"), F.lit(LINK), F.lit(1))).alias("dst"))
    far = far.select("src", ascii_lower(F.col("dst")).alias("dst"), F.lit(1.0).alias("n"))
    above = pages.groupBy("host").agg(F.lit(TIE).alias("n")).select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst"), "n").where("dst != ''")
    ties = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return far.unionByName(ties).where("src != '' AND dst != '' AND src != dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """links: src, dst, n; seeds: kind (trust or distrust), host, seed -> kind, host, rank.

    Each kind's seeds sum to one. Trust goes from src to dst, distrust from dst to src; what reaches a host without
    links on stays there. A step passes on what the last one added (grown), so ranks only grow. Ends when no rank grew
    by more than tolerance of itself in a step: from then on none does, and no new host is reached, since its neighbour
    would have had to be new before. Graphs of at most SMALL links and seeds are gone through on the driver; the ranks of
    others are written to the shared folder, and looked at, every few steps.
    """
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = staged(both.join(out.hint("merge"), ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all") * damping).alias("part")), "edges")
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("all"))
    start = staged(seeds.join(F.broadcast(total), "kind").select("kind", "host", (F.col("seed") / F.col("all")).alias("seed")), "seeds")
    if edges.count() <= SMALL and start.count() <= SMALL:
        return links.sparkSession.createDataFrame(_small(edges.toArrow(), start.toArrow(), damping, tolerance), "kind string, host string, rank double")
    seed = F.col("seed") * (1 - damping)
    now = start.select("kind", "host", seed.alias("rank"), seed.alias("grown"))
    growth = 1.0
    while growth > tolerance:
        for _ in range(STEPS_A_TABLE):
            moved = now.join(edges.hint("merge"), ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.lit(0.0).alias("rank"), (F.col("grown") * F.col("part")).alias("grown"))
            held = now.select("kind", "host", "rank", F.lit(0.0).alias("grown"))
            both = moved.unionByName(held).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("grown").alias("grown"))
            now = both.select("kind", "host", (F.col("rank") + F.col("grown")).alias("rank"), "grown")
        now = staged(now.where("rank > 0"), "ranks")
        growth = now.agg(F.max(F.col("grown") / F.col("rank"))).first()[0] or 0.0
    return now.select("kind", "host", "rank")


def _small(edges: pa.Table, start: pa.Table, damping: float, tolerance: float) -> pa.Table:
    """What propagate() does, on arrays."""
    at, to, first = (pc.binary_join_element_wise(t["kind"], t[c], " ") for t, c in ((edges, "host"), (edges, "dst"), (start, "host")))
    nodes = pa.chunked_array([*at.chunks, *to.chunks, *first.chunks], pa.string()).unique()
    src, dst, seeds = (pc.index_in(x, nodes).to_numpy() for x in (at, to, first))
    part = edges["part"].to_numpy()
    grown = np.bincount(seeds, start["seed"].to_numpy() * (1 - damping), len(nodes))
    rank = grown.copy()
    while (grown > tolerance * rank).any():
        grown = np.bincount(dst, grown[src] * part, len(nodes))
        rank += grown
    named = [x.split(" ", 1) for x in nodes.to_pylist()]
    reached = [(k, h, r) for (k, h), r in zip(named, rank.tolist(), strict=True) if r > 0]
    return pa.table({"kind": pa.array([x[0] for x in reached], pa.string()), "host": pa.array([x[1] for x in reached], pa.string()), "rank": pa.array([x[2] for x in reached], pa.float64())})


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], margin: float = MARGIN) -> DataFrame:
    """page_id, url, html -> page_id, host, path, rule, verdict, and the host's trust and distrust.

    Null urls and urls without :// have an empty host and path, which no rule fits and which is allowed; null html has no
    links; repeated rows are judged each; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumns({"rule": name, "by_rule": verdict})
    per_host = parsed.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("trust"), F.count_if(F.col("by_rule") == "block").alias("distrust"))
    seeds = per_host.select("host", "pages", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "n")).where("n > 0")
    ranks = propagate(links_of(parsed.select("host", "html")), seeds.select("kind", "host", (F.col("n") / F.col("pages")).alias("seed")))
    per = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    suspects = staged(
        per.where(F.col("distrust") > F.col("trust") + margin).join(per_host.select("host", "pages"), "host")
        .select(F.col("host").alias("s_host"), "trust", "distrust", "pages"), "suspects",
    )
    # Pages that a rule judges, or without a host, ask for no host's ranks. Of the hosts that are asked for, those with very
    # many pages are broadcast; there are fewer than 1 / HEAVY.
    asks = F.when(F.col("by_rule").isNull() & (F.col("host") != ""), F.col("host")).otherwise(F.concat(F.lit("/"), F.xxhash64("page_id", "path").cast("string")))
    free, floor = parsed.drop("html").withColumn("s_host", asks), parsed.count() * HEAVY
    hot = F.broadcast(suspects.where(F.col("pages") > floor))
    method = F.when(F.col("distrust").isNull(), "allow").otherwise("block")
    few = free.join(hot.select("s_host"), "s_host", "left_anti").join(suspects.hint("merge"), "s_host", "left")
    found = free.join(hot, "s_host").unionByName(few)
    return found.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "trust", "distrust")


def op8_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")
