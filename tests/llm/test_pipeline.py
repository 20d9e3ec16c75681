import collections

import pytest
from test_dedup import bag, classes_of
from test_text import PATH, check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from lodevec.llm import mixing, near_dedup, toxicity
from lodevec.llm.common import staged


def test_stages(spark, sf_dir):
    """Every stage's decision takes effect, and only its decision."""
    before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, before, sf_dir), name)
        rows = before.collect()
        if name != "packing":
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in toxicity.scored(before, model).where("score < 0.7").collect()}
        if name == "exact_dedup":
            top = {}
            for r in rows:
                key = "".join(c.lower() if c.isascii() else c for c in r["text"])
                top[key] = max(top.get(key, -1), r["doc_id"])
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(top.values())
        if name == "near_dedup":
            classes = near_dedup.near_classes(before).collect()
            kept = [r["doc_id"] for r in after.collect()]
            by = {r["id"]: r["class_id"] for r in classes}
            assert sorted(by[i] for i in kept) == sorted(set(by.values()))
            groups = classes_of({r["doc_id"]: bag(r["text"]) for r in rows})
            assert len(kept) == len(groups) and all(len(g & set(kept)) == 1 for g in groups)
        if name == "mixing":
            kept = collections.Counter(r["doc_id"] for r in after.collect())
            assert set(kept) == {r["doc_id"] for r in rows}
        if name == "packing":
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in rows}
            assert after.where("piece = 0").count() == len(rows)
            bins, least = check_packing(after.collect(), [(r["doc_id"], r["text"]) for r in rows], Tokenizer.from_file(PATH))
            assert bins <= least * 1.03 + 1
        before = after


@pytest.mark.parametrize("kind", ["odd", "clashing", "none"])
def test_stages_of_odd_tables(spark, sf_dir, request, kind):
    """Nulls, empty and very long texts, repeated rows, clashing columns and no rows go through every stage: copies go, one
    row of every class stays, null ids too."""
    before = docs = request.getfixturevalue(kind)
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, before, sf_dir), name)
        assert name == "packing" or after.columns == docs.columns
        if name in ("toxicity", "mixing"):
            assert {str(r["doc_id"]) for r in after.collect()} == {str(r["doc_id"]) for r in before.collect()}
        if name == "exact_dedup":
            texts = {"".join(c.lower() if c.isascii() else c for c in r["text"] or "") for r in before.collect()}
            assert after.count() == len(texts)
        if name == "near_dedup":
            rows = before.collect()
            assert after.count() == len(classes_of({k: bag(r["text"]) for k, r in enumerate(rows)}))
        if name == "packing":
            assert after.where("piece = 0").count() == before.count()
        before = after


def test_run(spark, sf_dir):
    assert set(corpus_pipeline.run(spark, sf_dir).columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert sum(mixing.TARGETS.values()) == 1
