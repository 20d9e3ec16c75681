"""Near-duplicate classes: BagMinHash signatures, banding, exact checks of weighted Jaccard similarity.

1. One pass over the texts gives each document its band keys and a name of its multiset of word shingles. Documents of
   one name are copies and go on as one.
2. Documents that share a band key share a bucket. In rounds, each bucket elects a pivot, and those of its members that
   are not yet in the pivot's class are compared with it, exactly. Links join classes (connected components). A bucket
   whose members share one class is done: its other pairs cannot change any class.
3. After two rounds every pair of different classes that still shares a bucket is compared, so no link between members
   of a bucket is lost: in small buckets pair by pair, in large ones by pairs of blocks, whose comparisons are a product
   of matrices inside one task, of which only the links of a spanning forest leave it.

What a bucket elects is written down before its members are joined with it, and so is everything else that is joined by a
key that many rows may share: both sides of such joins are plain exchanges, whose large partitions Spark splits.

Two multisets of similarity 0.8 share no bucket with a probability of (1 - 0.8^5)^26 = 3e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import one_of_each, staged, table, text_or_empty
from lodevec.llm.graph import components
from lodevec.llm.words import U, mix, shingles, slices

THRESHOLD, WORDS = 0.8, 5
#: Rounds of pivots; rows of a bucket up to which its pairs are listed; rows and shingles of a block of larger ones, about;
#: columns of a matrix at once.
ROUNDS, SMALL, BLOCK, BLOCK_SHINGLES, COLUMNS = 2, 64, 256, 1 << 20, 4096
SIGNED = "row long, id long, text_hash long, name1 long, name2 long, n long, keys array<long>"
LINKS = "a long, b long, u long, v long, similarity double"
NO_ID = 2**63 - 1


def signed(docs: DataFrame) -> DataFrame:
    """id, text -> SIGNED; row is unique."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodevec.llm.bagminhash import of_texts

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                keys, n, names = of_texts(texts, size=WORDS)
                k = len(texts)
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * keys.shape[1]), flat)
                cols = [pa.array(np.arange(row, row + k)), batch.column(0).slice(at, k), batch.column(1).slice(at, k), *(pa.array(x.view(np.int64)) for x in (names[:, 0].copy(), names[:, 1].copy())), pa.array(n.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["row", "id", "text_hash", "name1", "name2", "n", "keys"])
                row += k

    return docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, SIGNED)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """row, text -> row, bag: the sorted 64-bit hashes of the text's shingles, a repeated one's copies told apart."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodevec.llm.bagminhash import weighted

        for batch in batches:
            for at, texts in slices(batch.column(1)):
                d, h, w = weighted(*shingles(texts, WORDS))
                item = np.repeat(np.arange(len(d)), w)
                nth = np.arange(len(item)) - np.repeat(np.cumsum(w) - w, w)
                x = mix(h[item] + nth.astype(U))
                edges = np.searchsorted(d[item], np.arange(len(texts) + 1))
                bags = [np.sort(x[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(bags, pa.binary())], ["row", "bag"])

    return docs.select("row", "text").mapInArrow(hashed, "row long, bag binary")


def similarity(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def linked(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """pairs: a, b, u, v -> LINKS: those whose bags are alike enough."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            near = np.array([similarity(x.as_py(), y.as_py()) for x, y in zip(p.column(4), p.column(5), strict=True)], np.float64)
            ok = pa.array(near >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([*(p.column(k).filter(ok) for k in range(4)), pa.array(near).filter(ok)], ["a", "b", "u", "v", "similarity"])

    one = pairs.join(bags.select(F.col("row").alias("a"), F.col("bag").alias("bag_a")).hint("merge"), "a")
    both = one.join(bags.select(F.col("row").alias("b"), F.col("bag").alias("bag_b")).hint("merge"), "b")
    return both.select("a", "b", "u", "v", "bag_a", "bag_b").mapInArrow(alike, LINKS)


def similarities(bags: list[bytes]) -> np.ndarray:
    """Of all pairs of bags, as a square."""
    sets = [np.frombuffer(b, U) for b in bags]
    size = np.array([len(x) for x in sets], np.float64)
    value, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = np.flatnonzero(np.bincount(code, minlength=len(value)) > 1)
    column = np.full(len(value), -1)
    column[shared] = np.arange(len(shared))
    at = column[code]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for begin in range(0, len(shared), COLUMNS):
        a, b = np.searchsorted(at, [begin, begin + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[a:b], at[a:b] - begin] = 1
        both += has @ has.T
    return both / (size[:, None] + size[None] - both)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) of a spanning forest of a symmetric square of booleans."""
    unseen, out = np.ones(len(near), bool), []
    while unseen.any():
        front = np.flatnonzero(unseen)[:1]
        unseen[front] = False
        while len(front):
            found = near[front] & unseen
            to = np.flatnonzero(found.any(axis=0))
            out.append(np.stack([front[found[:, to].argmax(axis=0)], to]))
            unseen[to] = False
            front = to
    both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def linked_blocks(members: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """members: key, row, class, many, total (rows and shingles of the bucket) -> LINKS between classes in buckets of any
    size, enough of them to join all that are linked.

    A bucket's rows are dealt into blocks of about BLOCK rows or BLOCK_SHINGLES shingles by a hash, and each pair of
    blocks is one cell of work, in which at most one link for each row is found. A bag is sent to as many cells as its
    bucket has blocks.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links() -> pa.RecordBatch:
            rows = {r[0]: r for r in held}
            row, block, group = (np.array([r[k] for r in rows.values()]) for k in (0, 1, 2))
            alike = similarities([r[3] for r in rows.values()])
            near = (alike >= threshold - 1e-12) & (group[:, None] != group[None])
            if len(set(block.tolist())) > 1:
                near &= block[:, None] != block[None]
            i, j = forest(near)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (row[i], row[j], group[i], group[j], alike[i, j])], ["a", "b", "u", "v", "similarity"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != cell:
                    if len(held) > 1:
                        yield links()
                    cell, held = (key, i, j), []
                held.append(tuple(row))
        if len(held) > 1:
            yield links()

    blocks = F.ceil(F.greatest(F.col("many") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    dealt = members.select("key", "row", "class", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    whole = dealt.join(bags.hint("merge"), "row").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = whole.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "row", "block", "class", "bag")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, LINKS)


def open_buckets(members: DataFrame, turn: int) -> DataFrame:
    """members: key, row, n, class -> those of buckets in which classes differ, each with the bucket's rows and shingles
    (many, total) and its pivot (b, of m shingles, of class v). In the first turn the least row is the pivot, so copies
    of a pair in several buckets are one pair; then one that a hash picks."""
    lot = F.xxhash64("row", F.lit(turn)) if turn else F.lit(0).cast("long")
    per = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.sum("n").alias("total"), F.min("class").alias("c0"), F.max("class").alias("c1"),
        F.min(F.struct(lot.alias("lot"), F.col("row").alias("b"), F.col("n").alias("m"), F.col("class").alias("v"))).alias("p"),
    )
    split = staged(per.where("c0 != c1").select("key", "many", "total", "p.b", "p.m", "p.v"), "buckets")
    return staged(members.join(split, "key").select("key", "row", "n", "class", "many", "total", "b", "m", "v"), "members")


def _of_size(threshold: float) -> Column:
    """No pair whose sizes differ more can be alike enough."""
    return F.least("n", "m") >= F.greatest("n", "m") * threshold


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.where((F.col("class") != F.col("v")) & _of_size(threshold)).select(F.col("row").alias("a"), "b", F.col("class").alias("u"), "v").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, text_hash, class_id (the smallest id of its class), class_size, kept (true for one row
    of each class), copies (rows whose shingles are the same), links (other texts with which its text was compared and found
    alike enough), linked_id and similarity (of the most similar of those: its smallest id; null if there are none).

    Links are those that hold the classes together, not all that there are: pairs within a class that is already known to
    be one are not compared. Null texts are empty; texts without words are alike; a text of fewer than five words is one
    shingle; repeated rows are copies. Rows with a null id count, but a class has a null class_id only if none of its rows
    has an id; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return _classes(staged(signed(texts), "signatures"), texts, threshold)


def _classes(sigs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    spark = sigs.sparkSession
    distinct = staged(
        sigs.groupBy("name1", "name2").agg(F.min(F.struct("row", "id", "text_hash", "n", "keys")).alias("x"), F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "row")).alias("first"))
        .select("name1", "name2", "x.row", "x.id", "x.text_hash", "x.n", "x.keys", "copies", "first"),
        "distinct",
    )
    # Most keys occur once; what is shuffled for them is 16 bytes each, twice.
    every = distinct.select(F.explode("keys").alias("key"), "row")
    shared = staged(every.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("key"), "shared-keys")
    some = staged(every.join(shared.hint("merge"), "key"), "shared")
    members = open_buckets(some.join(distinct.select("row", "n").hint("merge"), "row").select("key", "row", "n", F.col("row").alias("class")), 0)
    wanted = staged(distinct.join(some.select("row").distinct().hint("merge"), "row", "left_semi").select("row", "id", "text_hash"), "wanted")
    keys = {"id": F.col("id"), "text_hash": F.xxhash64("text")}
    bags = staged(shingle_sets(one_of_each(texts, keys, wanted, sigs.select("id", "text_hash"), "row")), "bags")
    links, renamed = [], []

    def settle(found: DataFrame) -> bool:
        """Keeps the links and what they join; false if there are none."""
        found = staged(found, "found")
        if not found.head(1):
            return False
        links.append(found)
        renamed.append(staged(components(found).select(F.col("node").alias("class"), "root"), "moved"))
        return True

    def now(members: DataFrame) -> DataFrame:
        moved = members.select("key", "row", "n", "class").join(renamed[-1], "class", "left")
        return staged(moved.select("key", "row", "n", F.coalesce("root", "class").alias("class")), "renamed")

    for turn in range(ROUNDS):
        if settle(linked(_pairs(members, threshold), bags, threshold)):
            members = open_buckets(now(members), turn + 1)
        elif turn == 0:
            members = open_buckets(members.select("key", "row", "n", "class"), 1)
    if members.head(1):
        few = members.where(F.col("many") <= SMALL).select("key", "row", "n", "class")
        other = few.select("key", F.col("row").alias("b"), F.col("n").alias("m"), F.col("class").alias("v"))
        pairs = _pairs(few.join(other.hint("merge"), "key").where(F.col("row") < F.col("b")), threshold)
        settle(linked(pairs, bags, threshold).unionByName(linked_blocks(members.where(F.col("many") > SMALL), bags, threshold)))

    classes = distinct.select("name1", "name2", "copies", "first", "row", F.col("row").alias("class"))
    for moved in renamed:
        classes = classes.join(moved, "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")
    classes = staged(classes, "classes")
    summed = staged(classes.groupBy("class").agg(F.min("first").alias("top"), F.sum("copies").alias("class_size")), "summed")
    named = classes.join(summed, "class").select("name1", "name2", "row", "copies", "top", "class_size")
    named = staged(named.join(_nearest(spark, links, classes), "row", "left").drop("row"), "named")
    out = sigs.select("row", "id", "text_hash", "name1", "name2").join(named, ["name1", "name2"])
    known = F.when(F.col("top.id") < NO_ID, F.col("top.id"))
    return out.select("id", "text_hash", known.alias("class_id"), "class_size", (F.col("row") == F.col("top.row")).alias("kept"), "copies", F.coalesce("links", F.lit(0)).alias("links"), "linked_id", "similarity")


def _nearest(spark: SparkSession, links: list[DataFrame], classes: DataFrame) -> DataFrame:
    """row (of distinct texts) with links, linked_id, similarity."""
    both = spark.createDataFrame([], "row long, other long, similarity double")
    for x in links:
        both = both.unionByName(x.select(F.col("a").alias("row"), F.col("b").alias("other"), "similarity")).unionByName(x.select(F.col("b").alias("row"), F.col("a").alias("other"), "similarity"))
    per = both.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("links"), F.max(F.struct("similarity", (-F.col("other")).alias("minus"))).alias("best"))
    best = staged(per.select("row", "links", (-F.col("best.minus")).alias("other"), "best.similarity"), "best")
    ids = classes.select(F.col("row").alias("other"), F.when(F.col("first.id") < NO_ID, F.col("first.id")).alias("linked_id"))
    return best.join(ids, "other").drop("other")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one row of each class, with docs' own columns."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    sigs = staged(signed(texts), "signatures")
    winners = staged(_classes(sigs, texts, threshold).where("kept").select("id", "text_hash"), "winners")
    keys = {"id": F.col(id_col).cast("long"), "text_hash": F.xxhash64(text_or_empty(text_col))}
    return one_of_each(docs, keys, winners, sigs.select("id", "text_hash"))


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """linked: the most similar text that the document's was linked with, as id:similarity."""
    found = near_classes(table(spark, sf_dir, "documents"))
    linked = F.when(F.col("similarity").isNotNull(), F.concat_ws(":", F.coalesce(F.col("linked_id").cast("string"), F.lit("")), F.format_string("%.6f", "similarity")))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept", "copies", "links", linked.alias("linked"))
