"""Exact deduplication against a persistent digest index.

The index is a folder of segments, each a Parquet table bucketed and sorted by digest with one file a bucket, so that the
sort-merge join that looks new data up neither shuffles nor sorts what is indexed. A batch is reduced to one row per
digest first (with map-side combining, so a text that makes up a third of the rows costs one row per task, whether it is
indexed already or not), anti-joined with the segments, and the digests that are new become one more segment. When there
are more than MOST segments they are merged into one, which is the only time that indexed data are sorted.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import HEAVY, ascii_lower, listed, one_of_each, removed, scratch, staged, table, text_or_empty

#: Segments that are looked up one after the other; digests a bucket; the least buckets.
MOST, PER_BUCKET, LEAST_BUCKETS = 8, 4_000_000, 8
COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING, group_size BIGINT"


def digest(text: Column) -> Column:
    """SHA-256, as bytes, of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(ascii_lower(text_or_empty(text)), 256))


class DigestIndex:
    """digest -> the id that stays, at a path that outlives the session; one writer at a time.

    Opening an existing path continues it. The id that entered first stays: a later batch's row with an indexed digest is
    dropped whatever its id. A segment counts once Spark has marked it as written, so a job that dies leaves nothing
    behind that is read; a merged segment names those that it stands for, and they stop counting with the same mark.
    buckets: of each new segment; by its size if not given.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.tables: list[str] = []
        # The order in a bucket's one file is then known to the planner.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def segments(self) -> list[tuple[int, int, int]]:
        """(first, last, buckets) of the segments that count, oldest first."""
        names = [re.fullmatch(r"segment-(\d+)-(\d+)-(\d+)", x) for x in listed(self.spark, self.path)]
        whole = [tuple(map(int, m.groups())) for m in names if m and "_SUCCESS" in listed(self.spark, f"{self.path}/{m[0]}")]
        return sorted(s for s in whole if not any(o[0] <= s[0] and s[1] <= o[1] and o[:2] != s[:2] for o in whole))

    def _path(self, segment: tuple[int, int, int]) -> str:
        return f"{self.path}/segment-{segment[0]}-{segment[1]}-{segment[2]}"

    def _table(self, segment: tuple[int, int, int]) -> str:
        at, buckets = self._path(segment), segment[2]
        name = f"digest_index_{hashlib.md5(at.encode()).hexdigest()[:16]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{at}'")
        if name not in self.tables:
            self.tables.append(name)
        return name

    def _write(self, rows: DataFrame, first: int, last: int, many: int) -> None:
        buckets = self.buckets or max(LEAST_BUCKETS, 1 << (max(1, many) // PER_BUCKET).bit_length())
        removed(self.spark, self._path((first, last, buckets)))  # what a job that died while it committed may have left
        rows.repartition(buckets, "digest").sortWithinPartitions("digest").write.insertInto(self._table((first, last, buckets)))

    def rows(self) -> DataFrame:
        """All that is indexed: digest, keep_id, keep_row, batch, group_size."""
        out = self.spark.createDataFrame([], COLUMNS)
        for s in self.segments():
            out = out.unionByName(self.spark.table(self._table(s)))
        return out

    def lookup(self, groups: DataFrame) -> DataFrame:
        """groups (digest, each once) with found, what the index has of the digest; null if nothing."""
        found = [F.lit(None).cast("struct<keep_id: bigint, keep_row: bigint, batch: string, group_size: bigint>")]
        for k, s in enumerate(self.segments()):
            part = self.spark.table(self._table(s)).select("digest", F.struct("keep_id", "keep_row", "batch", "group_size").alias(f"_s{k}"))
            groups = groups.join(part.hint("merge"), "digest", "left")
            found.insert(0, F.col(f"_s{k}"))
        return groups.select(*(c for c in groups.columns if not c.startswith("_s")), F.coalesce(*found).alias("found"))

    def append(self, rows: DataFrame, batch: str) -> DataFrame:
        """rows: id, row (unique within the batch), digest -> one row a digest: digest, keep_id, keep_row, batch, group_size
        as they are in the index now, and many, how many of rows have it.

        Of equal digests the largest id enters (nulls last), and of rows that share that id, the one with the largest row
        number.
        """
        groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("many"))
        looked = staged(self.lookup(groups), "looked-up")
        new = F.struct(F.col("top.id").alias("keep_id"), F.col("top.row").alias("keep_row"), F.lit(batch).alias("batch"), F.col("many").alias("group_size"))
        fresh = looked.where("found IS NULL")
        if many := fresh.count():
            n = max((last for _, last, _ in self.segments()), default=-1) + 1
            self._write(fresh.select("digest", new.alias("x")).select("digest", "x.*"), n, n, many)
            if len(self.segments()) > MOST:
                self.merge()
        return looked.select("digest", "many", F.coalesce("found", new).alias("x")).select("digest", "x.*", "many")

    def merge(self) -> None:
        """Makes one segment of all."""
        old = self.segments()
        if len(old) > 1:
            rows = self.rows()
            self._write(rows, old[0][0], old[-1][1], rows.count())
            self.drop()
            for s in old:
                removed(self.spark, self._path(s))

    def drop(self) -> None:
        """Forgets the session's tables; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def _verdicts(index: DigestIndex, docs: DataFrame, batch: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = staged(
        docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text_col)).alias("digest")),
        "digests",
    )
    now = index.append(rows, batch)
    index.drop()
    heavy = F.broadcast(now.where(F.col("many") > rows.count() * HEAVY))  # fewer than 1 / HEAVY
    hot = rows.join(heavy, "digest")
    cold = rows.join(heavy.select("digest"), "digest", "left_anti").join(now.hint("merge"), "digest")
    kept = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
    return rows, hot.unionByName(cold).select("id", "row", "digest", "keep_id", "group_size", kept.alias("kept"))


def verdicts(index: DigestIndex, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends docs to the index and returns one row per document: id, row, digest, keep_id, group_size, kept.

    group_size counts the rows with that digest in the batch that brought it into the index; batches are to have names
    of their own. Null texts are empty texts; repeated rows are copies of each other, one of which stays; rows with a null
    id stay only if no copy has an id; an empty table gives no rows. The session's catalog is left as it was.
    """
    return _verdicts(index, docs, batch, id_col, text_col)[1]


def deduplicate(index: DigestIndex, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' own columns."""
    rows, found = _verdicts(index, docs, batch, id_col, text_col)
    keys = {"digest": digest(F.col(text_col)), "id": F.col(id_col).cast("long")}
    return one_of_each(docs, keys, found.where("kept").select("digest", "id"), rows.select("digest", "id"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, scratch(spark, "digest-index"))
    return verdicts(index, docs, "documents").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


ORACLE = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
