import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodevec import cli
from lodevec.functions import vectors as fv
from lodevec.operators import arrays, evaluate, index, kmeans, knn, pq, rng, stats
from lodevec.plans.build import build
from lodevec.sources import word2vec


def frame(spark, x, keys=None):
    keys = list(range(len(x))) if keys is None else keys
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in zip(keys, x, strict=True)], f"key {'string' if isinstance(keys[0], str) else 'long'}, vector array<float>")


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(5)
    centres = r.uniform(-5, 5, (6, 10))
    return (centres[r.integers(0, 6, 400)] + r.normal(0, 0.3, (400, 10))).astype(np.float32)


@given(st.integers(1, 80), st.integers(1, 40))
def test_split_covers(d, n):
    parts = fv.split_ranges(d, n)
    assert len(parts) == n and sum(w for _, w in parts) == d
    widths = [w for _, w in parts]
    assert max(widths) - min(widths) <= 1 and widths == sorted(widths, reverse=True)


@given(st.sampled_from(pq.WIDTHS), st.data())
def test_pack_round_trip(width, data):
    codes = data.draw(st.lists(st.integers(0, (1 << width) - 1), max_size=50))
    packed = pq.pack(np.array(codes, np.int64), width)
    assert len(packed) == pq.packed_size(width, len(codes))
    assert pq.unpack(packed, width, len(codes)).tolist() == codes


def test_pack_errors():
    with pytest.raises(ValueError):
        pq.pack(np.array([4]), 2)
    with pytest.raises(ValueError):
        pq.unpack(b"ab", 16, 3)
    for bad in (0, 65537):
        with pytest.raises(ValueError):
            pq.code_width(bad)


def test_java_random():
    assert rng.sample_rows(500, 5, 0) == [360, 448, 29, 447, 15]
    assert rng.sample_rows(512, 5, 3) == [374, 287, 36, 412, 34]


@settings(max_examples=60)
@given(st.lists(st.lists(st.floats(-1e3, 1e3), max_size=12), max_size=4))
def test_summary_merges(groups):
    whole = sum((stats.Summary.of(*g) for g in groups), stats.Summary())
    values = [v for g in groups for v in g]
    assert whole.count == len(values)
    if values:
        assert np.isclose(whole.mean, np.mean(values), atol=1e-6) and np.isclose(whole.variance, np.var(values), atol=1e-4)


@settings(max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 5)), max_size=40), st.integers(1, 8), st.integers(1, 5))
def test_best_is_sort_and_take(items, k, cut):
    best = arrays.Best(1, k)
    for i in range(0, len(items), cut):
        part = items[i : i + cut]
        best.add(np.array([0]), np.array([[float(d) for _, d in part]]), np.array([key for key, _ in part], object))
    _, keys, d = best.rows()
    assert sorted(zip(d, keys, strict=True)) == sorted((float(y), x) for x, y in items)[:k]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 9), st.sampled_from([1, 3, 50]), st.booleans())
def test_near_distances_find_what_a_sort_finds(seed, rows, queries, k, whole):
    """With ties (whole numbers), equal vectors, zero and NaN ones."""
    r = np.random.default_rng(seed)
    x = r.integers(0, 3, (rows, 4)).astype(float) if whole else r.normal(size=(rows, 4)) * 10
    x[r.random(rows) < 0.1] = np.nan
    q, best, key = x[r.integers(0, rows, queries)], arrays.Best(queries, k), r.permutation(rows)
    for at in range(0, rows, 7):
        i = np.arange(queries)
        best.add(i, arrays.near_distances(q, x[at : at + 7], k, best.worst(i)), key[at : at + 7])
    got = {}
    for i, name, d in zip(*best.rows(), strict=True):
        got.setdefault(int(i), []).append((round(float(d), 9), int(name)))
    for i in range(queries):
        want = sorted((round(float(((q[i] - v) ** 2).sum()), 9), int(n)) for v, n in zip(x, key, strict=True) if np.isfinite(v).all() and np.isfinite(q[i]).all())
        assert got.get(i, []) == want[:k]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 9), st.sampled_from([1, 3, 50]), st.booleans(), st.sampled_from([1.0, 1e-8, 1e9, 1e20]))
def test_offer_finds_what_a_sort_finds(seed, rows, queries, k, whole, scale):
    """With ties (whole numbers), equal vectors, NaN and infinite ones, and norms that single precision can't hold."""
    r = np.random.default_rng(seed)
    x = (r.integers(0, 3, (rows, 4)).astype(float) if whole else r.normal(size=(rows, 4)) * 10) * scale
    x[r.random(rows) < 0.1], x[r.random(rows) < 0.05] = np.nan, np.inf
    q, best, key = x[r.integers(0, rows, queries)], arrays.Best(queries, k), r.permutation(rows)
    for at in range(0, rows, 7):
        arrays.offer(best, q, x[at : at + 7], key[at : at + 7])
    got = {}
    for i, name, d in zip(*best.rows(), strict=True):
        got.setdefault(int(i), []).append((round(float(d), 9), int(name)))
    for i in range(queries):
        want = sorted((round(float(np.einsum("i,i", q[i] - v, q[i] - v)), 9), int(n)) for v, n in zip(x, key, strict=True) if np.isfinite(v).all() and np.isfinite(q[i]).all())[:k]
        if scale > 1:  # no ninth place in such numbers
            assert [round(d / scale**2, 6) for d, _ in got.get(i, [])] == [round(d / scale**2, 6) for d, _ in want]
        else:
            assert got.get(i, []) == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_flat_search_shuffles_queries_only(spark, clustered, monkeypatch, metric):
    """Each query is answered in one place, as in blocks that go to the index."""
    v = frame(spark, clustered, [f"k{i:03d}" for i in range(len(clustered))])
    found, q = build(v, metric, 8, 3, 2), v.select(F.col("key").alias("query_id"), "vector")
    here = found.query(q, 7)
    there = found.query(q, 7, block=150)
    plan = [x._jdf.queryExecution().optimizedPlan().toString() for x in (here, there)]
    assert "Window" not in plan[0] and "Window" in plan[1]
    a, b = ({(r["query_id"], r["rank"]): (r["key"], round(r["distance"], 9)) for r in x.collect()} for x in (here, there))
    assert a == b and len(a) == 7 * len(clustered)
    monkeypatch.setattr(index, "SENT", 100)
    assert "Window" in found.query(q, 7)._jdf.queryExecution().optimizedPlan().toString()


def peak(f):
    """MB that numpy and Python take at most while f runs."""
    import tracemalloc

    tracemalloc.start()
    f()
    size = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return size


def test_kernels_stay_small():
    r = np.random.default_rng(0)
    x, q = r.normal(size=(10_000, 64)), r.normal(size=(2048, 64))

    def search():
        best = arrays.Best(len(q), 10)
        for at in range(0, len(q), 128):
            i = np.arange(at, at + 128)
            best.add(i, arrays.near_distances(q[i], x, 10, best.worst(i)), np.arange(len(x)))

    assert peak(search) < 300
    assert peak(lambda: arrays.nearest(x[:2000], r.normal(size=(65_536, 64)))) < 300


def test_nearest_ties_and_nan():
    c = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    i, d = arrays.nearest(np.array([[1.0, 0.0], [0.5, 0.0]]), c)
    assert i.tolist() == [1, 0] and d.tolist() == [0.0, 0.25]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 9), st.booleans(), st.sampled_from([1.0, 1e-3, 1e20]))
def test_nearest_is_the_first_of_the_least(seed, rows, k, whole, scale):
    """With ties (whole numbers), equal centroids, NaN vectors, near ties and norms that single precision can't hold."""
    r = np.random.default_rng(seed)
    make = lambda n: (r.integers(0, 3, (n, 3)).astype(float) if whole else r.normal(size=(n, 3)).round(3) + r.normal(size=(n, 3)) * 1e-8) * scale
    x, c = make(rows), make(k)
    c[r.random(k) < 0.3] = 0
    x[r.random(rows) < 0.1] = np.nan
    index, d = arrays.nearest(x, c)
    for v, i, at in zip(x, index, d, strict=True):
        if np.isnan(v).any():
            assert i == 0 and np.isnan(at)
            continue
        every = ((v - c) ** 2).sum(axis=1)
        assert np.isclose(at, every.min(), rtol=1e-9, atol=1.1e-9)
        if scale == 1:
            assert i == np.flatnonzero(np.round(every, 9) == np.round(every, 9).min())[0]


def test_training_finds_each_code_once_a_round(spark, clustered, monkeypatch):
    calls, near = [], pq.nearest
    monkeypatch.setattr(pq, "nearest", lambda x, c: calls.append(len(x)) or near(x, c))
    monkeypatch.setattr(kmeans, "tally", lambda v, count: count(iter(v.toArrow().to_batches())))
    said = []
    pq.train(frame(spark, clustered).coalesce(1), 2, 4, 3, report=said.append)
    assert sum(calls) <= len(said) * 2 * len(clustered)


def test_normalize_zero(spark):
    out = frame(spark, [[0, 0], [3, 4]]).select(fv.normalize(F.col("vector")).alias("u"), fv.norm(F.col("vector")).alias("n")).collect()
    assert np.isnan(out[0]["u"]).all() and out[1]["u"] == [0.6, 0.8] and out[1]["n"] == 5


def test_zero_vector_is_no_neighbour_under_cosine(spark):
    v = frame(spark, [[0, 0], [3, 4], [4, 3]])
    got = knn.exact(v.where("key = 1").select(F.col("key").alias("query_id"), "vector"), v, 5, "cosine").collect()
    assert [r["key"] for r in got] == [1, 2]


def test_blocks_of_queries(spark, clustered):
    v = frame(spark, clustered[:60])
    q = v.select(F.col("key").alias("query_id"), "vector")
    assert sorted(knn.exact(q, v, 3, block=7).collect()) == sorted(knn.exact(q, v, 3).collect())


def test_kmeans_objective_falls_and_converges(spark, clustered):
    v = frame(spark, clustered).persist()
    c, last = kmeans.initial(v, 6, 1).centroids, np.inf
    for _ in range(5):
        total, many, _, objective = kmeans.sums(v, c)
        assert objective <= last + 1e-6
        last, c = objective, kmeans.means(total, many)
    said = []
    model = kmeans.train(v, 6, 100, 1, report=said.append)
    assert said[-1].converged
    a = model.assign(v).collect()
    assert {r["cluster"] for r in kmeans.KMeans(kmeans.iterate(v, model, 1).centroids).assign(v).collect()} == {r["cluster"] for r in a}


def test_kmeans_no_iterations_is_one_update(spark, clustered):
    v = frame(spark, clustered[:50])
    start = kmeans.initial(v, 3)
    assert np.allclose(kmeans.train(v, 3, 0, start=start).centroids, kmeans.iterate(v, start, 1).centroids)


@pytest.mark.parametrize("part", [False, True])
def test_training_uses_every_core(spark, clustered, monkeypatch, part):
    """However small the table: its rounds are many."""
    seen, train = [], pq.train
    monkeypatch.setattr(pq, "train", lambda v, *a, **b: seen.append([r["count"] for r in v.groupBy(F.spark_partition_id()).count().collect()]) or train(v, *a, **b))
    build(frame(spark, clustered).coalesce(1), "l2", 8, 2, 2, partitioned=part, partitions=2 if part else None)
    assert len(seen[0]) >= spark.sparkContext.defaultParallelism and max(seen[0]) < 1.5 * len(clustered) / len(seen[0])


def test_fingerprint_says_whether_an_index_changed():
    r = np.random.default_rng(0)
    x, index = r.normal(size=(300, 5)), r.integers(0, 9, 300)
    p, other = r.permutation(300), index.copy()
    other[17] += 1
    once = arrays.fingerprint(arrays.hashes(x), index)
    parts = sum((arrays.fingerprint(arrays.hashes(x[s]), index[s]) for s in (p[:100], p[100:])), np.zeros(1, np.uint64))
    assert parts[0] == once and arrays.fingerprint(arrays.hashes(x), other) != once


def test_pq_idempotent_and_better_with_more(spark, clustered):
    v = frame(spark, clustered).persist()
    errors = []
    for m, k in ((2, 4), (5, 16)):
        q = pq.train(v, m, k, 10)
        errors.append(q.error(v))
        x = clustered.astype(float)
        once = q.decode_rows(q.encode_rows(x))
        assert np.allclose(q.decode_rows(q.encode_rows(once)), once)
    assert errors[1] < errors[0]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("part", [False, True])
def test_index_is_exact_over_reconstructions(spark, clustered, tmp_path, metric, part):
    v = frame(spark, clustered, [f"k{i:03d}" for i in range(len(clustered))])
    found = build(v, metric, 16, 3, 4, partitioned=part, partitions=5 if part else None, limit=5 if part else None)
    q = v.limit(8).select(F.col("key").alias("query_id"), "vector")
    got = {(r["query_id"], r["rank"]): r["distance"] for r in found.query(q, 7).collect()}
    queries = q if metric == "l2" else q.withColumn("vector", fv.normalize(F.col("vector")))
    want = {(r["query_id"], r["rank"]): r["distance"] for r in knn.exact(queries, found.reconstruct().select("key", "vector"), 7).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x], atol=1e-6) for x in got)
    found.save(str(tmp_path / "i"))
    again = index.load(spark, str(tmp_path / "i"))
    assert sorted(again.query(q, 7).collect()) == sorted(found.query(q, 7).collect())
    wanted = spark.createDataFrame([("k003",), ("nope",)], "key string")
    assert {r["query_id"] for r in found.query_by_key(wanted, 3).collect()} == {"k003"}
    assert {r["key"]: r["vector"] is None for r in found.lookup(wanted).collect()} == {"k003": False, "nope": True}


def test_limit_vectors_boundaries(spark, clustered):
    v = frame(spark, clustered)
    coarse = kmeans.train(v, 5, 3)
    rows = index.grouped(v, coarse)
    q = pq.train(index.residuals(rows, coarse), 2, 4, 2)
    x = clustered[:4].astype(float)
    for n, want in ((0, 0), (1, 1), (10**6, None)):
        found = index.IVFPQIndex.build(rows, q, coarse, strategy=index.LimitVectors(n))
        assert all(len(p) == (len(found.partitions) if want is None else want) for p in found.probes(x))


def test_a_result_without_a_vector_is_an_error(spark, clustered):
    v = frame(spark, clustered)
    q = evaluate.sample(v, 5)
    with pytest.raises(Exception, match="no vector for the result"):
        evaluate.recall(knn.exact(q, v, 10), q, v.where("key < 300"), evaluate.truth(q, v, (1, 5))).collect()


def test_first_partition_wins(spark, clustered):
    """A key that stands in several partitions is found once, in the lowest."""
    v = frame(spark, np.concatenate([clustered[:200], clustered[200:210]]), [*range(200), *range(10)])
    found = build(v, "l2", 8, 2, 2, partitioned=True, partitions=5, limit=5)
    every = found.reconstruct().where("key < 10").collect()
    first = {}
    for r in every:
        first[r["key"]] = min(first.get(r["key"], (99, None)), (r["partition"], r["vector"]))
    got = {r["key"]: r["vector"] for r in found.lookup(spark.createDataFrame([(i,) for i in range(10)], "key long")).collect()}
    assert len(every) == 20 and len(got) == 10
    assert all(got[i] in [r["vector"] for r in every if r["key"] == i and r["partition"] == first[i][0]] for i in got)
    assert found.query_by_key(spark.createDataFrame([(3,)], "key long"), 4).count() == 4


def test_saved_index_reads_what_it_probes(spark, clustered, tmp_path):
    said = []
    found = build(frame(spark, clustered), "l2", 8, 2, 2, partitioned=True, partitions=8, limit=1, path=str(tmp_path / "i"), progress=lambda *a: said.append(a))
    assert {x[0] for x in said} == {"partitions", "quantizer"} and all(0 <= done <= total for _, done, total, _ in said)
    one = spark.createDataFrame([(0, [float(x) for x in clustered[0]])], "query_id long, vector array<float>")
    plan = found.query(one, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(partition" in plan
    codes = spark.read.parquet(str(tmp_path / "i" / "codes"))
    assert dict(codes.dtypes)["codes"] == "binary" and {len(r["codes"]) for r in codes.collect()} == {pq.packed_size(4, 2)}
    keys = {}
    for r in codes.select("*", F.input_file_name().alias("f")).collect():
        keys.setdefault(r["f"], []).append(r["key"])
    assert all(k == sorted(k) for k in keys.values())


def test_same_rows(spark, clustered):
    a = frame(spark, clustered[:20])
    assert fv.same_rows(a, a.orderBy(F.desc("key"))) and not fv.same_rows(a, a.where("key > 0")) and not fv.same_rows(a, a.unionByName(a))


def test_package_is_shipped(spark):
    """A worker that has only what was shipped can import it."""
    from lodevec.shared import ship

    ship(spark)
    ship(spark)
    assert spark.range(1).select(F.udf(lambda _: __import__("lodevec.shared").__name__)("id")).first()[0] == "lodevec"


def test_shared_folder_is_to_be_named(monkeypatch):
    from types import SimpleNamespace

    from lodevec.shared import shared_dir

    none = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: none)))


def test_recall_of_exact_results_is_one(spark, clustered):
    v = frame(spark, clustered)
    q = evaluate.sample(v, 20)
    r = evaluate.recall(knn.exact(q, v, 10), q, v, evaluate.truth(q, v, (1, 5, 10)), 0.0).collect()
    assert [(x["mean"], x["n"]) for x in sorted(r)] == [(1.0, 20)] * 3


@pytest.mark.parametrize("text,want", [("2 3\na 1 2 3\nb 4 5 6\n", 2), ("a 1 2 3\n\nb 4 5 6\r\n", 2), ("é 1 2\nß 3 4", 2), ("", 0)])
def test_word2vec(spark, tmp_path, text, want):
    (tmp_path / "v.txt").write_bytes(text.encode())
    rows = word2vec.read(spark, str(tmp_path / "v.txt")).collect()
    assert len(rows) == want and all(len(r["vector"]) in (2, 3) for r in rows)


def test_word2vec_drops_the_header_only(spark, tmp_path):
    """A line that reads like the header is a vector."""
    (tmp_path / "v.txt").write_text("3 1\n3 1\na 2\n3 1\n")
    assert [(r["key"], r["vector"]) for r in word2vec.read(spark, str(tmp_path / "v.txt")).collect()] == [("3", [1.0]), ("a", [2.0]), ("3", [1.0])]


@pytest.mark.parametrize("text", ["a 1 2\nb 1\n", "a 1 2\nb 1 2 3\n", "a 1 x\n"])
def test_word2vec_errors(spark, tmp_path, text):
    (tmp_path / "v.txt").write_text(text)
    with pytest.raises(Exception):
        word2vec.read(spark, str(tmp_path / "v.txt")).collect()


def test_word2vec_normalized(spark, tmp_path):
    word2vec.write(frame(spark, [[3, 4], [0.5, 0]], ["a", "b"]), str(tmp_path / "w"))
    rows = {r["key"]: r["vector"] for r in word2vec.read(spark, str(tmp_path / "w"), True).collect()}
    assert np.allclose(rows["a"], [0.6, 0.8]) and np.allclose(rows["b"], [1, 0])


def test_cli(spark, clustered, tmp_path, capsys):
    word2vec.write(frame(spark, clustered[:80], [f"w{i:02d}" for i in range(80)]), str(tmp_path / "v"))
    args = cli.parser().parse_args
    cli.run(args(["build-index", "-d", "l2", "-k", "8", "-m", "2", "-n", "3", "-p", "--partitions", "3", "-o", str(tmp_path / "i"), str(tmp_path / "v")]), spark)
    (tmp_path / "words").write_text("w03\nzzz\n")
    cli.run(args(["query-words", "-k", "3", "-i", str(tmp_path / "i"), str(tmp_path / "words")]), spark)
    out = capsys.readouterr().out
    assert "zzz: not found" in out and "w03: " in out
    cli.run(args(["query", "-k", "2", "-i", str(tmp_path / "i"), str(tmp_path / "v")]), spark)
    assert len(capsys.readouterr().out.splitlines()) == 80
    cli.run(args(["test", "-v", str(tmp_path / "v"), "-i", str(tmp_path / "i"), "-s", "10"]), spark)
    assert "R@1: " in capsys.readouterr().out
    with pytest.raises(SystemExit):
        args(["build-index", "-d", "l2", "-k", "0", "-o", "x", "y"])
    with pytest.raises(SystemExit):
        cli.run(args(["build-index", "-d", "l2", "-l", "3", "-o", "x", "y"]), spark)
    assert cli.bar(1, 2, 4) == "[##  ]  50 %" and cli.rate(10, 2.0) == 5 and cli.rate(1, 0) == 0
    assert cli.formatted_bytes(1500) == "1.5 kB" and cli.formatted_seconds(0.5) == "500 ms"


def test_stream_of_words(spark, clustered, tmp_path):
    from lodevec.streaming.words import answer

    found = build(frame(spark, clustered[:80], [f"w{i:02d}" for i in range(80)]), "l2", 8, 2, 2)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("w05\nnone\n")
    words = spark.readStream.format("text").load(str(tmp_path / "in")).withColumnRenamed("value", "key")
    q = answer(words, found, 3, str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
