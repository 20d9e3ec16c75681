"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into longer phrases, and so on. On each level a run of one
symbol is first folded into one; deterministic coin tossing then gives each symbol a label from its left neighbour (the
lowest bit in which the two differ, and its value), which after a few turns has six values with neighbours still
different; phrases begin where labels peak. Labels depend on a few symbols to the left only, so equal substrings get
the same phrases inside, wherever they stand. A phrase's name is a hash of what it holds.

A fingerprint is text: the name of the one phrase that parsing ends in, the number of phrases on each of the first three
levels, and for each of these a sketch of the set of its names (one-permutation minimum hashes). Likeness compares the
highest of the three on which both texts have enough phrases, so long texts are compared by long phrases and short ones by
short phrases.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import table, text_or_empty
from lodevec.llm.words import U, mix

#: Slots of each level's sketch; phrases that make a level worth comparing.
SLOTS, ENOUGH = (32, 32, 64), 12
EMPTY = 0xFFFF
BATCH = 1 << 20
#: Bytes of a part of the texts, about, and most parts by size (more only if shuffles have more): a part's texts go through a
#: task a batch at a time, so larger ones take longer but no more memory.
#: Cuts that are looked for; more parts are equal shares of the ranges between them.
PART_BYTES, MOST_PARTS, CUTS = 64 << 20, 1 << 18, 512
_LEAST = -(2**63)
BASE = U(0x9E3779B97F4A7C15)


@cache
def _tosses() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels of (left, own) for symbols below 256, 128, 16 and 8; where both are equal the label is not used."""

    def of(n: int) -> np.ndarray:
        left, own = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        differ = left ^ own
        low = np.zeros_like(differ)
        for bit in range(n.bit_length() - 2, -1, -1):
            low = np.where(differ >> bit & 1, bit, low)
        return (2 * low + (own >> low & 1)).astype(np.uint8).ravel()

    return of(256), of(128), of(16), of(8)


@cache
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[U(1)], np.full(63, BASE, U)]))


def _first_tosses(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 128 of 64-bit names (below 16 of bytes)."""
    left = np.concatenate([x[:1], x[:-1]])
    if x.dtype == np.uint8:
        label = _tosses()[0][left.astype(np.int32) << 8 | x]
    else:
        differ = left ^ x
        lowest = differ & (~differ + U(1))
        bit = np.log2(np.maximum(lowest, U(1)).astype(np.float64)).astype(np.uint8)
        label = (2 * bit + (x >> bit.astype(U) & U(1)).astype(np.uint8)).astype(np.uint8)
    label[first] = x[first].astype(np.uint8) & 7
    return label


def _again(label: np.ndarray, first: np.ndarray, table_: np.ndarray, width: int) -> np.ndarray:
    left = np.concatenate([label[:1], label[:-1]]).astype(np.int32)
    new = table_[left * width + label]
    new[first] = label[first] & 5
    return new


def parse(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts that lie between edges -> names of their phrases, and the edges of those."""
    n = len(x)
    if not n:
        return np.zeros(0, U), np.zeros_like(edges)
    begins = edges[:-1][edges[:-1] < edges[1:]]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    new[begins] = True
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, n))
    s = x[at]
    first = np.zeros(n, bool)
    first[begins] = True
    first = first[at]
    of_bytes, of_128, of_16, of_8 = _tosses()
    label = _first_tosses(s, first)
    if s.dtype != np.uint8:
        label = _again(label, first, of_128, 128)
    label = _again(label, first, of_16, 16)
    label = _again(label, first, of_8, 8)
    last = np.concatenate([first[1:], [True]])
    left, right = np.concatenate([label[:1], label[:-1]]), np.concatenate([label[1:], label[-1:]])
    peak = (label > left) & (label >= right) & ~first & ~last
    peak[1:] &= ~peak[:-1]
    start = np.flatnonzero(peak | first)
    long = np.diff(np.append(start, len(s)))
    place = np.minimum(np.arange(len(s)) - np.repeat(start, long), 63)
    value = mix(s.astype(U) + U(0x632BE5AB)) + np.where(run > 1, mix(run.astype(U) + U(0x1B873593)), U(0))
    names = mix(np.add.reduceat(value * _powers()[place], start) + long.astype(U))
    return names, np.searchsorted(at[start], edges)


def _sketch(names: np.ndarray, edges: np.ndarray, slots: int) -> np.ndarray:
    """texts x slots: 16 bits of the least hash among the names that fall into each slot, EMPTY where there are none."""
    texts = len(edges) - 1
    owner = np.repeat(np.arange(texts), np.diff(edges))
    h = mix(names ^ U(0xC2B2AE3D27D4EB4F))
    slot = (h & U(slots - 1)).astype(np.int64)
    least = np.full(texts * slots, np.iinfo(U).max, U)
    np.minimum.at(least, owner * slots + slot, h >> U(8))
    low = (least & U(0xFFFF)).astype(np.uint16)
    low[(low == EMPTY) & (least != np.iinfo(U).max)] = EMPTY - 1
    return low.reshape(texts, slots)


def fingerprints(texts: list[bytes]) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """Fingerprint, phrases on each of the three levels, and the three sketches of each text."""
    edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x: np.ndarray = np.frombuffer(b"".join(texts), np.uint8)
    counts, sketches = np.zeros((len(texts), 3), np.int64), []
    root = np.zeros(len(texts), U)
    for level, slots in enumerate(SLOTS):
        x, edges = parse(x, edges)
        counts[:, level] = np.diff(edges)
        sketches.append(_sketch(x, edges, slots))
    # Parsing goes on until every text is one phrase; its name, with the level it was reached on, names the text.
    level, open_ = len(SLOTS), np.ones(len(texts), bool)
    while open_.any():
        many = np.diff(edges)
        done = open_ & (many <= 1)
        has = done & (many == 1)
        root[has] = mix(x[edges[:-1][has]] + U(level))
        open_ &= ~done
        if open_.any():
            x, edges = parse(x, edges)
            level += 1
    root = mix(root + counts.sum(axis=1).astype(U))
    digits = np.concatenate(sketches, axis=1).astype(">u2")
    names = [f"{r:016x}.{a:x}.{b:x}.{c:x}.{d.tobytes().hex()}" for r, (a, b, c), d in zip(root.tolist(), counts.tolist(), digits, strict=True)]
    return names, counts, sketches


def likeness(counts_a: np.ndarray, sketches_a: list[np.ndarray], counts_b: np.ndarray, sketches_b: list[np.ndarray]) -> np.ndarray:
    """Share of slots filled in either that agree, on the highest level on which both have enough phrases (else the
    lowest); two texts without phrases are alike."""
    out = np.zeros(len(counts_a))
    open_ = np.ones(len(counts_a), bool)
    for level in (2, 1, 0):
        here = open_ & ((np.minimum(counts_a[:, level], counts_b[:, level]) >= ENOUGH) | (level == 0))
        a, b = sketches_a[level][here], sketches_b[level][here]
        filled = (a != EMPTY) | (b != EMPTY)
        many = filled.sum(axis=1)
        out[here] = np.where(many > 0, ((a == b) & filled).sum(axis=1) / np.maximum(many, 1), 1.0)
        open_ &= ~here
    return out


def compare(one: str, other: str) -> float:
    """Likeness of two fingerprints as they are written."""

    def read(text: str) -> tuple[np.ndarray, list[np.ndarray]]:
        _, a, b, c, digits = text.split(".")
        slots = np.frombuffer(bytes.fromhex(digits), ">u2")
        return np.array([[int(a, 16), int(b, 16), int(c, 16)]]), [x[None] for x in np.split(slots, np.cumsum(SLOTS)[:-1])]

    return 1.0 if one == other else float(likeness(*read(one), *read(other))[0])


def _cuts(docs: DataFrame, parts: int) -> list[tuple[int | None, int]]:
    """(id, hash) at which parts 1, 2, ... begin, in the order of ids (descending, nulls last) and then of hashes. An id
    with many rows, and null ids, are cut by hash."""
    rows, known = docs.agg(F.count(F.lit(1)), F.count("id")).first()
    wanted = round(parts * known / rows) if rows else 0
    out: list[tuple[int | None, int]] = []
    if wanted > 1:
        found = Counter(docs.where("id IS NOT NULL").approxQuantile("id", [i / wanted for i in range(1, wanted)], 0.2 / wanted))
        for i in sorted(found, reverse=True):
            out += [(int(i), _LEAST + (k << 64) // found[i]) for k in range(found[i])]
    nulls = max(parts - wanted, 1) if rows > known else 0
    return out + [(None, _LEAST + (k << 64) // nulls) for k in range(nulls)]


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """id, text -> part, ghost, id, text: in ranges of descending ids, each part in a task of its own, followed by a copy
    (ghost) of the row that follows its last one; the last part is followed by the first row of all.

    One exchange moves the texts. What the driver sees is one row for each part: its first key. Rows of one id are
    ordered by a hash of their text and by the text; null ids come last. Rows with the same id and text stay in one part.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("h", F.xxhash64("text"))
    parts = partitions or _parts_of(docs)
    cuts = _cuts(docs, min(parts, CUTS))
    each = -(-parts // (len(cuts) + 1))

    def reached(cut: tuple[int | None, int]) -> Column:
        i, h = cut
        if i is None:
            return F.col("id").isNull() & (F.col("h") >= h)
        return F.col("id").isNull() | (F.col("id") < i) | ((F.col("id") == i) & (F.col("h") >= h))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.coalesce(reached(cuts[mid]), F.lit(False)), tree(mid + 1, high)).otherwise(tree(low, mid))

    dealt = docs.withColumn("part", tree(0, len(cuts)).cast("int"))
    if each > 1:
        dealt = dealt.withColumn("part", F.col("part") * each + _share_of(docs, cuts, each))
    tops = dealt.groupBy("part").agg(F.max(F.struct("id", F.bitwise_not("h").alias("not_h"))).alias("top")).orderBy("part").collect()
    # The first row of each part is copied to the part before; that of the first part to the last.
    before = [(r["part"], r["top"]["id"], ~r["top"]["not_h"], tops[k - 1]["part"]) for k, r in enumerate(tops)]
    firsts = F.broadcast(spark.createDataFrame(before, "part int, first_id long, first_h long, before int"))  # one a part
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    to = F.struct(F.col("part"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("part"), F.lit(True).alias("ghost"))
    copies = dealt.join(firsts, "part").select("id", "text", "h", F.explode(F.when(is_first, F.array(*to)).otherwise(F.array(to[0]))).alias("to"))
    placed = copies.select("to.part", "to.ghost", "id", "h", "text")
    return placed.repartitionById((len(cuts) + 1) * each, "part").sortWithinPartitions("part", "ghost", F.col("id").desc_nulls_last(), "h", "text").drop("h")


def _share_of(docs: DataFrame, cuts: list[tuple[int | None, int]], each: int) -> Column:
    """Which of `each` equal shares of the range between two cuts a row is in, by how far its id is below the range's first
    one, and its hash as a fraction of that. part is the range's number."""
    top, low = docs.agg(F.max("id"), F.min("id")).first()
    begins = [(top, _LEAST), *cuts]
    from_, to = [(h - _LEAST) / (1 << 64) for _, h in begins], []
    for (i, _), nxt in zip(begins, [*cuts, None], strict=True):
        if nxt is not None and (nxt[0] is None) == (i is None):
            to.append((0 if i is None else i - nxt[0]) + (nxt[1] - _LEAST) / (1 << 64))
        else:
            to.append((0 if i is None else i - low) + 1.0)  # the last of the ids, or of all

    def at(values: list[float] | list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("part") + 1)

    first = at([0 if i is None else i for i, _ in begins])
    fraction = (F.col("h").cast("double") - float(_LEAST)) / float(1 << 64)
    key = F.coalesce((first - F.col("id")).cast("double"), F.lit(0.0)) + fraction
    share = F.floor((key - at(from_)) / at([max(b - a, 1e-9) for a, b in zip(from_, to, strict=True)]) * each)
    return F.greatest(F.lit(0), F.least(F.lit(each - 1), share)).cast("int")


def _parts_of(docs: DataFrame) -> int:
    """As many as other shuffles have, or by what the planner takes the input's size to be (if it has an idea of it),
    whichever is more."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size // PART_BYTES) if size < 1 << 60 else 1)


SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, with its text's fingerprint and that of the text whose last third is the next one's beginning.

    Null texts are empty; the only row of a table is its own next; a text of fewer than three code points is not edited;
    an empty table gives no rows. A text is held whole, with the next one, and as arrays of about 60 bytes for each of
    its own.
    """

    def run(rows: list[tuple], following: str) -> pa.RecordBatch:
        """rows: id, text, in order; following: the text after the last one."""
        texts = [t for _, t in rows] + [following]
        own = [t.encode() for t in texts]
        edited, sizes = [], []
        for t, nxt in zip(texts[:-1], texts[1:], strict=True):
            cut = len(t) // 3
            sizes.append(len(t))
            edited.append((t[: len(t) - cut] + nxt[:cut]).encode() if cut else t.encode())
        names, counts, sketches = fingerprints(own)
        e_names, e_counts, e_sketches = fingerprints(edited)
        k = len(rows)
        near_edited = likeness(counts[:k], [s[:k] for s in sketches], e_counts, e_sketches)
        near_next = likeness(counts[:k], [s[:k] for s in sketches], counts[1:], [s[1:] for s in sketches])
        same = [a == b for a, b in zip(names[:k], e_names, strict=True)]
        near_edited[same] = 1.0
        near_next[[a == b for a, b in zip(names[:-1], names[1:], strict=True)]] = 1.0
        return pa.RecordBatch.from_pydict(
            {
                "id": pa.array([i for i, _ in rows], pa.int64()), "n_chars": pa.array(sizes, pa.int64()), "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
                "fingerprint": names[:k], "edited_fingerprint": e_names, "near_edited": near_edited, "near_next": near_next,
            }
        )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, closing = 0, None, False
        for batch in batches:
            for p, ghost, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if p != part:
                    part, closing = p, False
                if closing:
                    continue
                if held and (size >= BATCH or ghost):
                    yield run(held, text)
                    held, size = [], 0
                if ghost:
                    closing = True
                    continue
                held.append((i, text))
                size += len(text)

    rows = with_next(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")))
    return rows.select("part", "ghost", "id", "text").mapInArrow(parts, SCHEMA)


def op5_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

