"""Queries by key from a stream of keys: each micro-batch is answered against the index as a batch is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodevec.operators.index import Index


def answer(words: DataFrame, index: Index, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """words: a streaming DataFrame with column key. Results (query_id, rank, key, distance) go to Parquet under path, one
    folder a batch, so a batch that runs again after a failure replaces its own results."""

    def batch(rows: DataFrame, number: int) -> None:
        index.query_by_key(rows.select("key"), k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return words.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
