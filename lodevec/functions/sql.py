"""The vector functions under names that SQL can call, as SQL functions that Spark inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

V = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "vec_add": (f"x {V}, y {V}", V, "zip_with(x, y, (a, b) -> a + b)"),
    "vec_subtract": (f"x {V}, y {V}", V, "zip_with(x, y, (a, b) -> a - b)"),
    "vec_distance_sq": (f"x {V}, y {V}", "DOUBLE", "aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, a) -> s + a)"),
    "vec_distance": (f"x {V}, y {V}", "DOUBLE", "sqrt(aggregate(zip_with(x, y, (a, b) -> (a - b) * (a - b)), 0D, (s, a) -> s + a))"),
    "vec_norm": (f"x {V}", "DOUBLE", "sqrt(aggregate(x, 0D, (s, a) -> s + a * a))"),
    "vec_normalize": (f"x {V}", V, "transform(x, a -> coalesce(try_divide(a, sqrt(aggregate(x, 0D, (s, b) -> s + b * b))), double('NaN')))"),
}


def register(spark: SparkSession) -> None:
    """vec_add, vec_subtract, vec_distance_sq, vec_distance, vec_norm, vec_normalize, and the table function word2vec_line,
    which makes a row (key, vector) of a line of word2vec text; for this session."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION word2vec_line(line STRING) RETURNS TABLE(key STRING, vector ARRAY<FLOAT>) "
        "RETURN SELECT split(line, ' ')[0], transform(slice(split(line, ' '), 2, size(split(line, ' ')) - 1), t -> CAST(t AS FLOAT))"
    )
