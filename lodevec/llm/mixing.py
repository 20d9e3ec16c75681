"""Mixing to target weights by soft membership.

A classifier trained on a labelled table gives every document a posterior over domains, so its tokens count for several
domains in part. Nonnegative rates (how often a document is to be used, in expectation) are found by projected-gradient
least squares: the domains' expected token totals, sum of rate x tokens x posterior, are to match the targets.

The gradient for one document is its tokens times its posterior's product with the residual, a vector of one number a
domain. Steps are scaled by 1 / tokens for each document and by the inverse of sum(tokens x posterior x posterior') for
the residual (over the documents whose rate is free to move), which makes the problem well conditioned. A document's rate
then follows from its posterior and the residuals so far, which is all that a round of the loop has to pass on: one
aggregation to a few numbers, no state per document.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.llm.common import labelled_texts, staged, table, text_or_empty
from lodevec.llm.words import U, mix, raw_bytes, slices, words

#: Labelled rows of each domain that the classifier is fitted on, at most; buckets of hashed words.
SAMPLE, BUCKETS = 3000, 4096
#: Rounds at most; how near totals are to be to the targets, or to those of the least squares, in shares of the targets' sum.
ROUNDS, TOLERANCE, NEAR = 60, 1e-6, 1e-5
#: Cells of a posterior's scale in which rows are added up for most rounds; rounds over all rows after these, at most.
GRID, POLISH = 4096, 8
# The production targets, shares of all tokens by domain.
TARGETS = {"low": 0.12, "high": 0.88}


def domain_of_labels() -> Column:
    return F.when(F.col("quality") == 1, "high").otherwise("low")


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of hashed words by square root of their share, shares of kinds of characters; words."""
    found = words(texts)
    hashes, n = found.hashes, np.diff(found.first)
    text = np.repeat(np.arange(len(texts)), n)
    key = text * BUCKETS + (hashes >> U(52)).astype(np.int64) % BUCKETS
    code, count = np.unique(key, return_counts=True)
    owner = code // BUCKETS
    value = np.sqrt(count / np.maximum(n[owner], 1))
    raw, edges = raw_bytes(texts)
    long = np.maximum(np.diff(edges), 1)
    dense = [np.minimum(np.log1p(n) / 10, 2)]
    for hit in (~np.isin(raw, np.frombuffer(b" \n\t.,;:!?'\"()-", np.uint8)) & (raw < 128) & ~((raw >= 48) & (raw <= 57)) & ~((raw | 32) >= 97) , (raw >= 48) & (raw <= 57), raw == 10, (raw == 42) | (raw == 37) | (raw == 38) | (raw == 36) | (raw == 35)):
        total = np.concatenate([[0], np.cumsum(hit)])
        dense.append(4 * np.sqrt((total[edges[1:]] - total[edges[:-1]]) / long))
    distinct = np.bincount(np.unique(text * (1 << 20) + (mix(hashes) >> U(44)).astype(np.int64)) >> 20, minlength=len(texts)) / np.maximum(n, 1)
    dense.append(distinct)
    rows = np.concatenate([owner, np.tile(np.arange(len(texts)), len(dense))])
    cols = np.concatenate([code % BUCKETS, np.repeat(BUCKETS + np.arange(len(dense)), len(texts))])
    return rows, cols, np.concatenate([value, *dense]), n


DENSE = 6


log = logging.getLogger("lodevec")


class Rates(NamedTuple):
    """rate: of each row, as an expression; reached: the expected totals by domain; end: "met" (all totals are the targets),
    "least squares" (no rates meet the targets; these come as near as any) or "rounds" (not shown to be either)."""

    rate: Column
    reached: np.ndarray
    end: str


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """texts x domains, and the number of tokens (words, at least one) of each text."""
        rows, cols, value, n = _features(texts)
        z = np.zeros((len(texts), len(self.domains)))
        for k in range(len(self.domains)):
            z[:, k] = np.bincount(rows, value * self.weights[cols, k], len(texts)) + self.bias[k]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), np.maximum(n, 1)


def fit(domains: list[str], rows: list[tuple[int, bytes, bytes]], share: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> Classifier:
    """Multinomial logistic regression by accelerated gradient descent; rows: domain, columns, values."""
    width = BUCKETS + DENSE
    weights, bias = np.zeros((width, len(domains))), np.zeros(len(domains))
    if not rows:
        return Classifier(domains, weights, bias)
    y = np.array([r[0] for r in rows])
    cols = [np.frombuffer(r[1], np.int32) for r in rows]
    x = np.zeros((len(rows), width), np.float32)
    for i, (c, r) in enumerate(zip(cols, rows, strict=True)):
        x[i, c] = np.frombuffer(r[2], np.float32)
    w = share[y] / share[y].sum()
    onehot = np.eye(len(domains))[y]
    step = 1 / (0.5 * float((w * (x * x).sum(axis=1)).sum()) + penalty)
    a, last = np.zeros((width + 1, len(domains))), np.zeros((width + 1, len(domains)))
    for k in range(rounds):
        ahead = a + k / (k + 3) * (a - last)
        z = x @ ahead[:-1].astype(np.float32) + ahead[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = w[:, None] * (p - onehot)
        grad = np.vstack([x.T @ g.astype(np.float32) + penalty * ahead[:-1], g.sum(axis=0)])
        last, a = a, ahead - step * grad
    return Classifier(domains, a[:-1], a[-1])


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """labelled: doc_id, domain. Fits on at most `sample` rows of each domain, picked by a hash of the id; rows of other
    domains, repeated ids beyond the first (label or document), and ids without a document do not count."""
    known = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    picked = None
    for d in domains:
        some = known.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                rows, cols, value, _ = _features(texts)
                order = np.lexsort((cols, rows))
                rows, cols, value = rows[order], cols[order].astype(np.int32), value[order].astype(np.float32)
                e = np.searchsorted(rows, np.arange(len(texts) + 1))
                out = [pa.array([v[a:b].tobytes() for a, b in zip(e[:-1], e[1:], strict=True)], pa.binary()) for v in (cols, value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *out], ["domain", "cols", "vals"])

    joined = labelled_texts(docs, picked, id_col, text_col)  # at most domains x sample rows, whatever is repeated
    got = joined.select("domain", "text").mapInArrow(extract, "domain string, cols binary, vals binary").collect()
    rows = sorted((domains.index(r["domain"]), bytes(r["cols"]), bytes(r["vals"])) for r in got)
    taken = np.bincount([r[0] for r in rows], minlength=len(domains)) if rows else np.ones(len(domains))
    share = np.array([counts.get(d, 0) for d in domains]) / np.maximum(taken, 1)
    return fit(domains, rows, np.maximum(share, 1e-9))


def memberships(docs: DataFrame, model: Classifier, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (docs' own if none are named) with tokens long and p array<double>, the posterior by domain."""
    keep = docs.columns if keep is None else keep
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts in slices(batch.column(at)):
                p, n = model.posteriors(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, len(p)) for c in range(at)), pa.array(n.astype(np.int64)), lists], [*keep, "_tokens", "_p"])

    picked = docs.select(*keep, text_or_empty(text_col).alias("_text"))
    fields = [*picked.schema.fields[:-1], T.StructField("_tokens", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))]
    return picked.mapInArrow(run, T.StructType(fields))


def _rate(history: list[np.ndarray], start: float, least: float) -> Column:
    """The rate after the steps so far: each takes posterior . step away and stops at the least rate."""
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in history))
    if not history:
        return F.lit(start)

    def one(rate: Column, step: Column) -> Column:
        return F.greatest(F.lit(least), rate - F.aggregate(F.zip_with("_p", step, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))

    return F.aggregate(steps, F.lit(start), one)


def rates(members: DataFrame, targets: list[float], least: float = 0.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Rates:
    """members: _tokens, _p -> each row's rate.

    targets: token totals by domain; least: the lowest rate, zero or more. Ends when all totals are within tolerance of
    the sum of targets, when the totals are shown to lie within NEAR of those of the least squares (no rates meet the
    targets), or after rounds, which is logged as a warning. The round with the least error counts, not the last one.

    A rate depends on the posterior alone, so most rounds go over rows added up by posteriors that agree to 1 / GRID; then
    up to POLISH rounds go over all rows, from the rates found and with each row's own posterior, and it is these that end
    as said above.

    The proof is the problem's dual: a vector that no posterior has a negative product with bounds from below what any
    rates reach. The residual, less its least product with a posterior (which sum to one), is such a vector; half the
    squared error is at most the gap above that bound, and the totals are at most sqrt(2 x gap) from the best ones. Where
    targets are out of reach, the exact least squares would repeat a few documents of the outermost posteriors without
    end, so running out of rounds is no failure there.
    """
    k, t = len(targets), np.array(targets)
    p = [F.col("_p")[i] for i in range(k)]
    tokens = F.col("_tokens").cast("double")
    cells = members.groupBy(*(F.floor(x * GRID).alias(f"g{i}") for i, x in enumerate(p))).agg(F.sum(tokens).alias("_tokens"), *(F.sum(tokens * x).alias(f"s{i}") for i, x in enumerate(p)))
    coarse = staged(cells.where("_tokens > 0").select("_tokens", F.array(*(F.col(f"s{i}") / F.col("_tokens") for i in range(k))).alias("_p"), *(f"s{i}" for i in range(k))), "posteriors")
    first = coarse.agg(F.sum("_tokens"), *(F.sum(f"s{i}") for i in range(k))).first()
    total, lowest = float(first[0] or 0), least * np.array([float(x or 0) for x in first[1:]])
    if not total:
        return Rates(F.lit(0.0), np.zeros(k), "met" if not t.any() else "least squares")
    start = max(float(t.sum() / total), least)
    steps, _, _ = _solved(coarse, t, total, lowest, start, least, [], rounds, tolerance)
    steps, reached, end = _solved(members, t, total, lowest, start, least, steps, min(rounds, POLISH), tolerance)
    log.log(logging.WARNING if end == "rounds" else logging.INFO, "mixing: %s, targets %s, expected totals %s", end, t.tolist(), reached.tolist())
    return Rates(_rate(steps, start, least), reached, end)


def _solved(members: DataFrame, t: np.ndarray, total: float, lowest: np.ndarray, start: float, least: float, steps: list[np.ndarray], rounds: int, tolerance: float) -> tuple[list[np.ndarray], np.ndarray, str]:
    """Projected gradient from the given steps on: the steps up to the best round, its totals, and how it ended."""
    k, history = len(t), list(steps)
    p = [F.col("_p")[i] for i in range(k)]
    error, best, kept, pace = np.inf, np.inf, (0, np.zeros(k)), 1.0
    residual, end = None, "rounds"
    free = F.when(F.col("rate") > least, F.col("_tokens")).otherwise(0)
    for _ in range(rounds):
        rated = members.select("_tokens", "_p", _rate(history, start, least).alias("rate"))
        slope = sum((p[i] * float(residual[i]) for i in range(k)), F.lit(0.0)) if residual is not None else F.lit(0.0)  # of the round before
        sums = rated.agg(
            *(F.sum(F.col("_tokens") * F.col("rate") * p[i]) for i in range(k)), *(F.sum(free * p[i] * p[j]) for i in range(k) for j in range(k)), F.min(slope)
        ).first()
        if residual is not None:
            dual = residual + max(0.0, -float(sums[-1]))
            gap = (residual @ residual + dual @ dual) / 2 + dual @ (t - lowest)
            if np.sqrt(2 * max(gap, 0.0)) <= NEAR * t.sum():
                end = "least squares"
                break
        reached, gram = np.array([float(x) for x in sums[:k]]), np.array([float(x) for x in sums[k:-1]]).reshape(k, k)
        if np.trace(gram) < 1e-6 * total:
            gram = total * np.eye(k)  # every rate is at the least
        residual = reached - t
        if np.linalg.norm(residual) < best:
            best, kept = np.linalg.norm(residual), (len(history), reached)
        last, error = error, float(np.abs(residual).max())
        if error <= tolerance * t.sum():
            end = "met"
            break
        pace = min(1.0, pace * 1.5) if error < last else pace / 2
        history.append(pace * np.linalg.inv(gram + 1e-9 * (np.trace(gram) + total) * np.eye(k)) @ residual)
    return history[: kept[0]], kept[1], end


def targets_for(members: DataFrame, weights: list[float]) -> list[float]:
    """The least token totals in the ratio of weights that reach every domain's present total, so that no domain shrinks."""
    k = len(weights)
    sums = members.agg(*(F.sum(F.col("_tokens") * F.col("_p")[i]) for i in range(k))).first()
    now = [float(x or 0) for x in sums]
    scale = max((x / w for x, w in zip(now, weights, strict=True) if w > 0), default=0.0)
    return [w * scale for w in weights]


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tokens, domain (the likeliest), posterior (array by domain, in targets' order), rate.

    Null texts are empty (one token counts); repeated rows get rates of their own; an empty table gives no rows; with no
    labels all posteriors are even.
    """
    domains = list(targets)
    model = train(docs, labelled, domains, id_col, text_col)
    members = staged(memberships(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, keep=["doc_id"]), "members")
    rate = rates(members, targets_for(members, [targets[d] for d in domains])).rate
    names = F.array(*map(F.lit, domains))
    best = names[F.array_position(F.col("_p"), F.array_max("_p")).cast("int") - 1]
    return members.select("doc_id", F.col("_tokens").alias("tokens"), best.alias("domain"), F.col("_p").alias("posterior"), rate.alias("rate"))


def repeated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' own columns, each row as often as its rate says: the whole part, and once more with the probability of the
    rest, drawn by a hash of the id and the text. Rates are one or more: no document goes, scarce domains are repeated.
    The expected totals meet the targets as rates() says; those drawn differ from them by chance."""
    domains = list(targets)
    model = train(docs, labelled, domains, id_col, text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    safe = docs.toDF(*names)
    key, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    with_p = staged(memberships(safe, model, text), "members")  # whole rows, so that texts are classified once
    rate = rates(with_p, targets_for(with_p, [targets[d] for d in domains]), least=1.0).rate
    whole = F.floor(F.col("_rate"))
    drawn = F.pmod(F.xxhash64(key, text, F.lit(3)), F.lit(1 << 20)) / (1 << 20)
    copies = with_p.withColumn("_rate", rate).withColumn("_many", (whole + F.when(drawn < F.col("_rate") - whole, 1).otherwise(0)).cast("int")).where("_many > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_many")))).select(*names).toDF(*docs.columns)


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", domain_of_labels().alias("domain"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)
