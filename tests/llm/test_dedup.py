import collections
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodevec.llm import bagminhash, exact_dedup, graph, near_dedup, queries
from lodevec.llm.common import LOWER, UPPER, scratch, staged
from lodevec.llm.words import shingles


def lowered(t):
    return (t or "").translate(str.maketrans(UPPER, LOWER))


def test_exact_equals_sql(spark, sf_dir):
    got = queries.QUERIES["op2_exact_dedup"](spark, sf_dir).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.sql(queries.ORACLE["op2_exact_dedup"]).df()
    cols = sorted(want.columns)
    assert got[cols].sort_values("doc_id").values.tolist() == want[cols].sort_values("doc_id").values.tolist()


def test_exact_odd(spark, odd, odd_rows):
    out = exact_dedup.verdicts(exact_dedup.DigestIndex(spark, scratch(spark, "t"), 4), odd, "b").collect()
    assert len(out) == len(odd_rows)
    groups = collections.defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[hashlib.sha256(lowered(t).encode()).hexdigest()].append(i)
    for digest, ids in groups.items():
        rows = [r for r in out if bytes(r["digest"]).hex() == digest]
        known = [i for i in ids if i is not None]
        assert len(rows) == len(ids) and {r["group_size"] for r in rows} == {len(ids)}
        assert {r["keep_id"] for r in rows} == {max(known) if known else None} and sum(r["kept"] for r in rows) == 1


def test_index_persists_and_grows(spark, tmp_path):
    path = "file://" + str(tmp_path / "index")
    new = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, path, 4)
    one = exact_dedup.deduplicate(index, new((1, "A"), (2, "a"), (3, "b")), "one").collect()
    assert sorted(r["doc_id"] for r in one) == [2, 3]
    index.drop()
    again = exact_dedup.DigestIndex(spark, path, 4)
    two = exact_dedup.deduplicate(again, new((0, "B"), (9, "a"), (5, "c")), "two").collect()
    assert [r["doc_id"] for r in two] == [5]
    assert {(r["batch"], bytes(r["digest"]).hex()[:6]) for r in again.rows().collect()} == {(b, hashlib.sha256(t).hexdigest()[:6]) for b, t in (("one", b"a"), ("one", b"b"), ("two", b"c"))}
    again.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_indexed_data_are_neither_sorted_nor_shuffled(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "file://" + str(tmp_path / "index"))
    rows = lambda a, b: spark.range(a, b).select(F.col("id"), F.col("id").alias("row"), exact_dedup.digest(F.col("id").cast("string")).alias("digest"))
    for k in range(3):
        index.append(rows(k * 100, k * 100 + 150), f"b{k}")
    groups = staged(rows(0, 400).groupBy("digest").agg(F.count(F.lit(1)).alias("many")), "g")
    looked = index.lookup(groups)
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Bucketed: true") == 3
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # of what is looked up, once for all segments
    assert looked.where("found IS NULL").count() == 50
    index.drop()


def test_segments_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST", 2)
    index = exact_dedup.DigestIndex(spark, "file://" + str(tmp_path / "index"))
    new = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    for k in range(4):
        out = exact_dedup.deduplicate(index, new((k, f"t{k}"), (9, "t0"), (k + 10, f"T{k}")), f"b{k}").collect()
        assert sorted(r["doc_id"] for r in out) == ([10] if k == 0 else [k + 10])
    assert len(index.segments()) == 2 and index.rows().count() == 4
    # A segment that was never marked as written does not count.
    (tmp_path / "index" / "segment-99-99-8").mkdir()
    assert len(index.segments()) == 2
    index.drop()


def test_repeated_rows_and_hot_texts_of_any_batch(spark, tmp_path):
    """A third of the rows is one row repeated, a third one text with many ids; so it is in the next batch."""
    rows = [(7, "Same row", "x")] * 3000 + [(i, "one TEXT" if i % 2 else "One text", "y") for i in range(100, 3100)] + [(i, f"text {i}", "z") for i in range(5000, 8000)] + [(None, "No id", "n")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    index = exact_dedup.DigestIndex(spark, "file://" + str(tmp_path / "index"))
    out = exact_dedup.deduplicate(index, docs, "one").collect()
    assert collections.Counter(r["lang"] for r in out) == {"x": 1, "y": 1, "z": 3000, "n": 1}
    assert {r["doc_id"] for r in out if r["lang"] == "y"} == {3099}
    out = exact_dedup.verdicts(index, docs.unionByName(spark.createDataFrame([(1, "new", "w")], docs.schema)), "two")
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(joins) == 3
    got = out.collect()
    assert [r["id"] for r in got if r["kept"]] == [1] and len(got) == 9051
    assert {r["keep_id"] for r in got if r["group_size"] == 3000} == {7, 3099}
    out = exact_dedup.deduplicate(index, docs, "three")
    assert out.count() == 0


def test_exact_keeps_columns(spark, clashing, odd_rows, none):
    out = exact_dedup.deduplicate(exact_dedup.DigestIndex(spark, scratch(spark, "t"), 4), clashing, "b")
    assert out.columns == clashing.columns and out.count() == len({lowered(t) for _, t, *_ in odd_rows})
    assert exact_dedup.deduplicate(exact_dedup.DigestIndex(spark, scratch(spark, "t"), 4), none, "b").count() == 0


def bag(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return collections.Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) > 4 else [tuple(w)])


def jaccard(a, b):
    same = sum((a & b).values())
    return same / (sum(a.values()) + sum(b.values()) - same)


def classes_of(bags):
    keys, up = list(bags), {k: k for k in bags}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if bags[a].keys() & bags[b].keys() and jaccard(bags[a], bags[b]) >= 0.8:
                up[root(a)] = root(b)
    out = collections.defaultdict(set)
    for k in keys:
        out[root(k)].add(k)
    return {frozenset(v) for v in out.values()}


def test_near_equals_brute_force(spark, sf_dir, texts):
    got = queries.QUERIES["op4_bagminhash"](spark, sf_dir).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["class_id"]].add(r["doc_id"])
    assert {frozenset(v) for v in by.values()} == classes_of({i: bag(t) for i, t in texts.items()})
    assert all(min(v) == k for k, v in by.items()) and sum(r["kept"] for r in got) == len(by)
    assert all(r["class_size"] == len(by[r["class_id"]]) for r in got)
    bags = {i: bag(t) for i, t in texts.items()}
    near = {r["doc_id"]: r["linked"].split(":") if r["linked"] else (None, None) for r in got}
    rows = [{"id": i, "class_id": r["class_id"], "links": r["links"], "linked_id": near[i][0] and int(near[i][0]), "similarity": near[i][1] and float(near[i][1])} for r in got for i in [r["doc_id"]]]
    check_links(rows, bags, {r["id"]: r for r in rows}, 1e-6)


def check_links(rows, bags, by, within=1e-9):
    """Every text of a class of different texts has a link, and its similarity is what it says."""
    for r in rows:
        i = r["id"]
        alone = all(bags[j] == bags[i] for j, x in by.items() if x["class_id"] == r["class_id"])
        assert (r["links"] == 0) == alone == (r["linked_id"] is None) == (r["similarity"] is None)
        if not alone:
            assert by[r["linked_id"]]["class_id"] == r["class_id"] and bags[r["linked_id"]] != bags[i]
            assert r["similarity"] >= 0.8 and abs(r["similarity"] - jaccard(bags[i], bags[r["linked_id"]])) < within


def test_long_words_that_a_polynomial_cannot_tell_apart(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} two three four five"), (2, f"{b} two three four five"), (3, a), (4, b), (5, a)]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["id"]: r["class_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_forest():
    r = np.random.default_rng(2)
    for _ in range(30):
        near = r.random((20, 20)) < 0.08
        near |= near.T
        np.fill_diagonal(near, False)
        i, j = near_dedup.forest(near)
        assert near[i, j].all()
        up = list(range(20))
        for a, b in zip(*np.nonzero(near), strict=True):
            up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
        assert len(i) == 20 - len(set(up))
        joined = list(range(20))
        for a, b in zip(i, j, strict=True):
            joined = [min(joined[a], joined[b]) if x in (joined[a], joined[b]) else x for x in joined]
        assert joined == up


def test_hot_class_of_different_texts(spark, monkeypatch):
    """Many near copies whose similarities straddle the threshold, in buckets larger than a block."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for k in r.choice(120, r.integers(0, 6), replace=False):
            t[k] = f"x{i}y{k}"
        rows.append((i, " ".join(t)))
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = collections.defaultdict(set)
    for x in got:
        by[x["class_id"]].add(x["id"])
    assert {frozenset(v) for v in by.values()} == classes_of({i: bag(t) for i, t in rows})
    check_links(got, {i: bag(t) for i, t in rows}, {r["id"]: r for r in got})


def test_near_odd(spark, odd, odd_rows, clashing, none):
    out = near_dedup.near_classes(odd).collect()
    assert len(out) == len(odd_rows)
    seven = {r["class_id"] for r in out if r["id"] in (7, 8)}
    assert seven == {7} and {r["class_id"] for r in out if r["id"] in (4, 5)} == {4}
    assert {r["class_id"] for r in out if r["id"] in (1, 2, 3)} == {1}
    kept = near_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.count() == len({r["class_id"] for r in out})
    assert near_dedup.near_classes(none).count() == 0


def test_signatures_are_unbiased():
    r, got = np.random.default_rng(0), []
    for _ in range(150):
        u = r.integers(0, 1 << 62, 50).astype(np.uint64)
        a, b = r.integers(0, 9, 50), r.integers(0, 9, 50)
        i, j = np.flatnonzero(a), np.flatnonzero(b)
        s = bagminhash.signatures(np.r_[np.zeros(len(i), int), np.ones(len(j), int)], np.r_[u[i], u[j]], np.r_[a[i], b[j]], 2, 256)
        got.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(got)) < 4 * np.std(got) / len(got) ** 0.5 + 1e-9


def test_signature_does_not_depend_on_the_batch():
    texts = ["a b c d e f g h", "", "one", "a b c d e f g h a b c d e f g h a b c d e f g h"]
    alone = [bagminhash.of_texts(pa.array([t]))[0][0].tolist() for t in texts]
    assert bagminhash.of_texts(pa.array(texts))[0].tolist() == alone


def test_shingles():
    d, h = shingles(pa.array(["Hello, world a b c d e", "hello WORLD a b c d e", "a b", "A  b", "", "..."]))
    by = {k: h[d == k].tolist() for k in range(6)}
    assert by[0] == by[1] and len(by[0]) == 3 and by[2] == by[3] and by[4] == by[5] and len(by[4]) == 1


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)] + [(i, 99) for i in range(60, 70)]])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    up = {}
    for a, b in links:
        up.setdefault(a, a)
        up.setdefault(b, b)
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if k != v}
