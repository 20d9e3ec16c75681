"""Histogram sort: shards of near-equal bytes, cut at exact byte counts, with one exchange of the rows.

Rows are ordered by (hash of the text, id, row number). Rounds of counting find the shards - 1 splitters of that order:
each round adds up, in one aggregation with map-side combining, the exact bytes and rows of equal-width cells between the
smallest and the largest key that can still hold a splitter, and keeps for each splitter the one cell in which its byte
target falls. A splitter is settled when a cell edge is within the tolerance, or its cell holds one row only. Within one
text (a hot group) the rounds go on over the ids, and within one id over the row numbers, so nothing is too alike to be
split. The driver sees at most cells x splitters counts a round, whatever the input's size.

Equal texts are neighbours, so they share a shard unless a splitter has to fall among them; a splitter that falls into a
group moves to the group's nearer end if that costs less than group_slack of a shard.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import staged, table, text_or_empty

SIZE_OVERHEAD = 16
#: What rows are ordered by, in turn; row is unique.
KEYS = ("h", "id", "row")
LEAST, MOST = -(2**63), 2**63 - 1
Key = tuple[int, ...]


class _Open(NamedTuple):
    """Keys of a level between low and high, the levels before being fixed, in which targets fall; below: bytes before."""

    fixed: Key
    low: int
    high: int
    below: int
    targets: list[int]

    @property
    def level(self) -> str:
        return KEYS[len(self.fixed)]

    def holds(self) -> Column:
        out = F.col(self.level).between(self.low, self.high)
        for name, value in zip(KEYS, self.fixed, strict=False):
            out &= F.col(name) == value
        return out


def _cell(key: Column, low: int, high: int, cells: int) -> Column:
    """Which of the equal-width cells over low..high holds key. Widths are powers of two: shifts can't overflow."""
    shift = next(s for s in range(65) if (high >> s) - (low >> s) < cells)
    return F.shiftright(key, shift) - F.lit(low >> shift)


def _after(fixed: Key, value: int) -> Key:
    """The least key beyond all that begin with fixed and value."""
    prefix = [*fixed, value]
    while prefix and prefix[-1] == MOST:
        prefix.pop()
    return _padded((*prefix[:-1], prefix[-1] + 1)) if prefix else (MOST,) * len(KEYS)


def _padded(key: Key) -> Key:
    return key + (LEAST,) * (len(KEYS) - len(key))


def splitters(rows: DataFrame, shards: int, cells: int = 1024, tolerance: float = 0.001, group_slack: float = 0.01) -> list[Key]:
    """rows: h, id, row, size (all long, not null; h in 0 to 2^62). The (h, id, row) at which shards 1, 2, ... begin."""
    whole = rows.agg(F.sum("size"), F.min("h"), F.max("h")).first()
    total = int(whole[0] or 0)
    if not total or shards < 2:
        return []
    mean = total / shards
    open_cells = [_Open((), int(whole[1]), int(whole[2]), 0, [round(i * mean) for i in range(1, shards)])]
    found: dict[int, Key] = {}
    while open_cells:
        parts = [F.when(c.holds(), F.struct(F.lit(k).alias("k"), _cell(F.col(c.level), c.low, c.high, cells).cast("long").alias("cell"), F.col(c.level).alias("key"))) for k, c in enumerate(open_cells)]
        counts = (
            rows.select("size", F.coalesce(*parts).alias("at")).where("at IS NOT NULL").groupBy("at.k", "at.cell")
            .agg(F.sum("size").alias("bytes"), F.min("at.key").alias("least"), F.max("at.key").alias("most")).collect()
        )
        by: dict[int, list] = {}
        for r in counts:
            by.setdefault(r["k"], []).append(r)
        later = []
        for k, c in enumerate(open_cells):
            line = sorted(by[k], key=lambda r: r["cell"])
            ends = [c.below + x for x in accumulate(r["bytes"] for r in line)]
            inside: dict[int, list[int]] = {}
            for t in c.targets:
                i = min(bisect_left(ends, t), len(line) - 1)
                r, start = line[i], ends[i] - line[i]["bytes"]
                one = r["least"] == r["most"]
                slack = group_slack * mean if one and c.level == KEYS[0] else tolerance * mean
                if min(t - start, ends[i] - t) <= slack or (one and c.level == KEYS[-1]):
                    nearer = t - start <= ends[i] - t
                    found[t] = _padded((*c.fixed, r["least"])) if nearer else _after(c.fixed, r["most"])
                else:
                    inside.setdefault(i, []).append(t)
            for i, ts in inside.items():
                r, start = line[i], ends[i] - line[i]["bytes"]
                fixed = (*c.fixed, r["least"]) if r["least"] == r["most"] else c.fixed
                later.append(_Open(fixed, LEAST, MOST, start, ts) if len(fixed) > len(c.fixed) else _Open(fixed, r["least"], r["most"], start, ts))
        open_cells = later
    return [found[round(i * mean)] for i in range(1, shards)]


def shard_of(at: list[Key]) -> Column:
    """How many splitters are at or below (h, id, row): a balanced tree of comparisons."""

    def reached(key: Key) -> Column:
        out = F.col(KEYS[-1]) >= key[-1]
        for name, value in reversed(list(zip(KEYS[:-1], key[:-1], strict=True))):
            out = (F.col(name) > value) | ((F.col(name) == value) & out)
        return out

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(reached(at[mid]), tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(at)).cast("int")


def shard_by_bytes(rows: DataFrame, shards: int, per_cell: int = 100_000, **how) -> DataFrame:
    """rows: h, id, row, size and any more columns -> the same with shard and slot, the place in the shard (gapless from 0).

    Slots are counted in cells of a shard, dealt by a hash of the row number, so no task holds a whole shard: the counts
    of the cells (at most shards x 4096) are added up first, and the one exchange numbers the rows within each cell.
    Repeated rows get places of their own. A table with no rows gives no rows.
    """
    at = splitters(rows, shards, **how)
    cells = max(8, min(4096, rows.count() // (shards * per_cell) + 1))
    dealt = rows.withColumns({"shard": shard_of(at), "_cell": F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int")})
    counts = dealt.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("n")).collect()
    base, done = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["_cell"])):
        base.append((r["shard"], r["_cell"], done.get(r["shard"], 0)))
        done[r["shard"]] = done.get(r["shard"], 0) + r["n"]
    bases = F.broadcast(rows.sparkSession.createDataFrame(base, "shard int, _cell int, _base long"))
    numbered = dealt.withColumn("_place", F.expr("row_number() OVER (PARTITION BY shard, _cell ORDER BY h, id, row)"))
    return numbered.join(bases, ["shard", "_cell"]).withColumn("slot", F.col("_base") + F.col("_place") - 1).drop("_base", "_place", "_cell")


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in shards of near-equal bytes (law "bytes"). Null texts count as empty, null ids sort as the
    smallest; rows that are equal in everything can be in different shards; very long texts are as good as any, but a
    shard cannot be evener than its longest document."""
    text = text_or_empty()
    rows = staged(
        table(spark, sf_dir, "documents").select(
            "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), F.monotonically_increasing_id().alias("row"), F.shiftrightunsigned(F.xxhash64(text), 2).alias("h"),
            (F.octet_length(text) + SIZE_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        "sizes",
    )
    return shard_by_bytes(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE: dict[str, str] = {}
