import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    r = random.Random(3)
    words = ["alpha", "béta", "gamma", "delta", "epsilon", "zeta", "日本", "don't", "a1b2"]
    long = " ".join(r.choices(words, k=60_000))
    texts = [(1, None), (2, ""), (3, "   \n"), (4, "One two three four five six seven"), (5, "one TWO three four five six seven"), (6, "short"), (7, long), (7, long), (8, long + " end"), (None, "no id here at all"), (None, None), (9, "x" * 50_000), (10, "😀 naïve ﬁ\x00 text  with odd characters"), (4, "One two three four five six seven"), (11, "\"';--")]
    return [(i, t, None if k % 3 else "en", None, None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with more columns, named as operators might name theirs."""
    from pyspark.sql import functions as F

    names = ["id", "row", "key", "digest", "kept", "score", "text_hash", "_text", "_tokens", "_p", "__id", "__hash", "__digest", "class", "name1", "c0", "part", "ghost", "piece", "h", "size", "toxic"]
    return odd.select("*", *(F.lit(f"extra {n}").alias(n) for n in names))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
