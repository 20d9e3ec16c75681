"""Shared helpers: reading tables, staged tables, keys that many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.shared import hadoop, listed, removed, scratch, shared_dir

__all__ = ["hadoop", "listed", "removed", "scratch", "shared_dir"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than this share of the rows is handled by broadcast; there are fewer than 1 / HEAVY such keys.
HEAVY = 1 / 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage in a way that outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; where every character is one byte, lower() does just that and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use, in any case."""
    used, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in used:
        name += "_"
    return name


def one_of_each(docs: DataFrame, keys: dict[str, Column], winners: DataFrame, rows: DataFrame, take: str | None = None) -> DataFrame:
    """docs' rows with a key among winners', one row of each key, with docs' own columns, and the column take of winners.

    keys: expressions over docs, of which some may be null, by the names they have in winners (keys that stay, each once)
    and rows (every row's key). Whole rows are shuffled once, by their key. A key of more than HEAVY of the rows, that is
    one row repeated, is not: its rows are reduced within tasks first.
    """
    names = {k: free_name(docs, k) for k in keys}
    nulls = {k: free_name(docs, f"no_{k}") for k in keys}

    def marked(df: DataFrame, of: dict[str, Column]) -> DataFrame:
        """With keys that are never null, so that join and aggregation want the same partitioning."""
        kinds = dict(rows.dtypes)
        zero = {k: F.lit(0).cast(kinds[k]) if kinds[k] != "binary" else F.lit(b"") for k in of}
        return df.withColumns({names[k]: F.coalesce(c, zero[k]) for k, c in of.items()} | {nulls[k]: c.isNull() for k, c in of.items()})

    on = [*names.values(), *nulls.values()]
    own = {k: F.col(k) for k in keys}
    brought = [take] if take else []
    known, every, whole = marked(winners, own).select(*on, *brought), marked(rows, own).select(*on), marked(docs, keys)
    how, out = "inner" if take else "left_semi", [*docs.columns, *brought]
    many = every.groupBy(*on).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > rows.count() * HEAVY).select(*on)
    hot = staged(many.join(known.hint("merge"), on, how), "hot-keys")
    if not hot.head(1):
        return whole.join(known.hint("merge"), on, how).dropDuplicates(on).select(*out)
    few = F.broadcast(hot)  # fewer than 1 / HEAVY
    cold = whole.join(few, on, "left_anti").join(known.hint("merge"), on, how).dropDuplicates(on)
    return cold.unionByName(whole.join(few, on, how).dropDuplicates(on)).select(*out)


def labelled_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """picked: doc_id and more columns, each id once, few -> those columns but doc_id, and text: one row for each id that
    docs have, with the least of its texts (null is empty), however often the id is repeated."""
    more = [c for c in picked.columns if c != "doc_id"]
    few = F.broadcast(picked.withColumnRenamed("doc_id", "_picked"))
    found = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(few, F.col("_id") == F.col("_picked"))
    return found.groupBy("_picked", *more).agg(F.min("text").alias("text")).select(*more, "text")
