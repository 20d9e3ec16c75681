"""Keyed vectors as word2vec text: an optional line "<size> <dimension>", then "key f1 f2 ..." lines.

Lines are split by Spark's text source and parsed by built-in functions; only the first line is looked at on its own, and
if it is a header it alone is dropped, whatever other lines read.
Blank lines are skipped; a line of another number of tokens, or a token that is no number, is an error. Keys are UTF-8
and may hold anything but a space or a line end.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions.vectors import normalize


def header(first: str) -> tuple[int, int] | None:
    """Size and dimension, if the line is a header. A header-less file of one dimension whose first key and value are
    whole numbers looks like one, too."""
    m = re.fullmatch(r"(\d+) (\d+)", first.rstrip("\r"))
    return (int(m[1]), int(m[2])) if m else None


def read(spark: SparkSession, path: str, normalized: bool = False) -> DataFrame:
    """key string, vector array<float>; an empty file gives no rows."""
    # A line's number within its file's part tells the header from a line that reads the same.
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    first = lines.where("trim(value) != ''").first()
    if first is None:
        return spark.createDataFrame([], "key string, vector array<float>")
    head = header(first["value"])
    dimension = head[1] if head else len(first["value"].rstrip("\r").split(" ")) - 1
    return parsed(lines.where(F.trim("value") != ""), dimension, first["_line"] if head else None, normalized)


def parsed(lines: DataFrame, dimension: int, skip: int | None = None, normalized: bool = False) -> DataFrame:
    """lines: value, _line -> key, vector of each line but the one numbered skip."""
    tokens = F.split(F.rtrim(F.regexp_replace("value", r"\r$", "")), " ")
    odd = F.lit(False) if skip is None else F.col("_line") == skip
    # Said of the skipped line, too: a filter on the result may be evaluated before the one that drops it.
    checked = F.when((F.size(tokens) == dimension + 1) | odd, tokens).otherwise(F.raise_error(F.concat(F.lit(f"not a line of {dimension} numbers: "), F.substring("value", 1, 80))))
    vector = F.transform(F.slice(checked, 2, dimension), lambda t: t.cast("float"))
    out = lines.where(~odd).select(F.element_at(checked, 1).alias("key"), vector.alias("vector"))
    return out.withColumn("vector", normalize(F.col("vector")).cast("array<float>")) if normalized else out


def write(vectors: DataFrame, path: str, with_header: bool = False) -> None:
    """A folder of text files, one line for each vector; with_header: as one file, which takes one task."""
    lines = vectors.select(F.concat_ws(" ", F.col("key").cast("string"), F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")).alias("value"))
    if with_header:
        first = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).select(F.format_string("%d %d", "n", F.coalesce("d", F.lit(0))).alias("value"))
        lines = first.withColumn("o", F.lit(0)).unionByName(lines.withColumn("o", F.lit(1))).coalesce(1).sortWithinPartitions("o").select("value")
    lines.write.mode("overwrite").text(path)


def reader_stats(vectors: DataFrame) -> DataFrame:
    """One row: how many vectors there are, characters a key, and bytes that keys (two a character) and vectors (four an
    element) take in memory."""
    keys = F.col("key").cast("string")
    return vectors.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.char_length(keys)).alias("chars_per_key"),
        (F.coalesce(F.sum(2 * F.char_length(keys).cast("long")), F.lit(0)) + F.coalesce(F.sum(4 * F.size("vector").cast("long")), F.lit(0))).alias("memory_bytes"),
    )


def words(spark: SparkSession, path: str | None) -> DataFrame:
    """The lines of a file, or of standard input, as column key."""
    if path:
        return spark.read.text(path).select(F.rtrim(F.regexp_replace("value", r"\r$", "")).alias("key")).where("key != ''")
    import sys

    return spark.createDataFrame([(x.rstrip("\r\n"),) for x in sys.stdin if x.strip()], "key string")
