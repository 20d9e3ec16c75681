"""Every query that has SQL gives what DuckDB gives."""

import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lodevec.operators import kmeans
from lodevec.plans import catalog

SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck(sf_dir).sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=0, atol=1.5e-6)


def test_converged_equals_sql_beyond_its_rounds(spark, tmp_path):
    """Over vectors that go on changing clusters after the rounds of the SQL."""
    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": np.arange(len(x), dtype=np.int32) % 10}), tmp_path / "embeddings.parquet")
    v = catalog.keyed(catalog.vectors(spark, str(tmp_path)))
    said = []
    kmeans.train(v, 3, catalog.ROUNDS + 1, start=catalog.start(spark, str(tmp_path), [0, 1, 2]), report=said.append)
    assert not said[-1].converged
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = entry.queries()["kmeans_converged"](spark, str(tmp_path)).toPandas().sort_values("cluster").reset_index(drop=True)
    want = c.sql(SQL["kmeans_converged"]).df().sort_values("cluster").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False, rtol=0, atol=1.5e-5)


def test_entry(spark):
    assert entry.entry(spark).count() == 250


@pytest.mark.parametrize("name", ["flat_trained_query", "ivf_trained_query"])
def test_trained_recall(spark, sf_dir, name):
    """Of the ten exact neighbours of every twentieth vector nine tenths are found, at their exact distances."""
    got = {(r["query_id"], r["key"]): r["distance"] for r in entry.queries()[name](spark, sf_dir).collect()}
    want = {(r["query_id"], r["key"]): r["distance"] for r in entry.queries()["exact_knn_l2"](spark, sf_dir).collect()}
    asked = {q for q, _ in want}
    assert asked == {q for q, _ in got} == {i for i in range(spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()) if i % 20 == 0}
    both = got.keys() & want.keys()
    assert len(both) >= 0.9 * len(want) and all(abs(got[k] - want[k]) < 1e-6 for k in both)
