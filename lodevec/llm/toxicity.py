"""Toxicity by weak supervision.

Many voters look at a text: lexicons written down here, patterns of its characters, and terms (words, and beginnings of
words) mined from labelled training rows, each of which fires or not. A generative label model treats the true class as
hidden: expectation maximisation estimates each voter's rate of firing in either class, on which voter it depends there
and how strongly, with the given label as one more noisy voter. Its posteriors are the labels on which a linear
(logistic) classifier of the voters is trained; that classifier scores every text.

The model is fitted on a sample bounded by SAMPLE: terms are counted on the executors, and the driver gets some 30 bytes
a row, which voters fire. Scoring is one pass over the texts with no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodevec.llm.common import labelled_texts, staged, table, text_or_empty
from lodevec.llm.words import U, mix, raw_bytes, slices, words

#: Labelled rows of each class that the model is fitted on, at most; mined terms kept; least likelihood ratio of a term.
SAMPLE, TERMS, EVIDENCE = 6000, 192, 15.0
THRESHOLD = 0.7
#: Lengths in bytes of the beginnings of words that count as terms.
BEGINNINGS = (4, 5, 6)

# Lexicons of common insults and of words of address.
LEXICONS = {
    "insult_en": "idiot idiots moron morons loser losers scum trash clown imbecile fool jerk creep freak pig".split(),
    "contempt_en": "stupid worthless pathetic disgusting dumb ugly useless filthy vile repulsive".split(),
    "insult_de": "idiot trottel dummkopf depp abschaum versager widerlich erbärmlich wertlos dumm".split(),
    "insult_fr": "idiot imbécile crétin ordure raclure minable pathétique dégoûtant stupide nul".split(),
    "insult_es": "idiota imbécil estúpido basura escoria payaso patético asqueroso inútil perdedor".split(),
    "threat": "kill hurt destroy die töten sterben tuer mourir matar morir".split(),
    "address": "you your du dein ihr tu toi vous tú usted".split(),
}
PATTERNS = ["exclaims", "shouts", "symbols", "no_words"]


def _word_hash(word: str) -> int:
    return int(words(pa.array([word])).hashes[0])


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every word and of every word's beginnings."""
    w = words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    found = [(text, w.hashes)]
    for n in BEGINNINGS:
        has = w.end - w.begin > n
        b = w.begin[has]
        found.append((text[has], mix(w.sums[b + n] - w.sums[b] + U(n))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pattern_votes(texts: pa.Array, has_words: np.ndarray) -> np.ndarray:
    """texts x PATTERNS, from shares of characters; has_words: whether each text has any."""
    out = np.zeros((len(texts), len(PATTERNS)), bool)
    data, ends = raw_bytes(texts)
    long = np.maximum(np.diff(ends), 1)
    sums = {}
    for name, hit in (("!", data == 33), ("upper", (data >= 65) & (data <= 90)), ("symbol", np.isin(data, np.frombuffer(b"#$%&*@^~", np.uint8)))):
        total = np.concatenate([[0], np.cumsum(hit)])
        sums[name] = (total[ends[1:]] - total[ends[:-1]]) / long
    out[:, 0], out[:, 1], out[:, 2] = sums["!"] > 0.01, sums["upper"] > 0.3, sums["symbol"] > 0.05
    out[:, 3] = ~has_words
    return out


@dataclass
class Model:
    """terms: sorted hashes; column: the voter of each; weights over voters, and bias."""

    terms: np.ndarray
    column: np.ndarray
    voters: int
    weights: np.ndarray
    bias: float
    names: list[str]

    def votes(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), self.voters), bool)
        text, h = term_hashes(texts)
        k = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[k] == h
        out[text[hit], self.column[k[hit]]] = True
        has_words = np.zeros(len(texts), bool)
        has_words[text] = True
        out[:, -len(PATTERNS) :] = pattern_votes(texts, has_words)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.votes(texts).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text -> term, n1, n0: how many of this task's texts of either class have the term."""
    terms, n1, n0 = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for at, texts in slices(batch.column(1)):
            toxic = batch.column(0).slice(at, len(texts)).to_numpy(zero_copy_only=False)
            text, h = term_hashes(texts)
            order = np.lexsort((h, text))
            text, h = text[order], h[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
            one = toxic[text[new]] == 1
            terms, code = np.unique(np.concatenate([terms, h[new]]), return_inverse=True)
            n1, n0 = (np.bincount(code, np.concatenate([n, hit]), len(terms)).astype(np.int64) for n, hit in ((n1, one), (n0, ~one)))
    if len(terms):
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n1), pa.array(n0)], ["term", "n1", "n0"])


def mined(sample: DataFrame, rows1: int, rows0: int) -> list[int]:
    """Hashes of the terms that speak for class 1 the most, by likelihood ratio (G squared): at most TERMS."""
    if not rows1 or not rows0:
        return []
    counts = sample.mapInArrow(term_counts, "term long, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b"))

    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    a, b, p = F.col("a"), F.col("b"), (F.col("a") + F.col("b")) / (rows1 + rows0)
    g = 2 * (part(a, rows1 * p) + part(b, rows0 * p) + part(rows1 - a, rows1 * (1 - p)) + part(rows0 - b, rows0 * (1 - p)))
    strong = counts.where((a >= 3) & (a / rows1 > 4 * b / rows0)).withColumn("g", g).where(F.col("g") >= EVIDENCE)
    return [r["term"] & (1 << 64) - 1 for r in strong.orderBy(F.desc("g"), "term").limit(TERMS).collect()]


def _tree(strength: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in a maximum spanning forest of edges of at least that strength; -1 for roots (Prim's way)."""
    n = len(strength)
    parent, best, out = np.full(n, -1), np.zeros(n), np.ones(n, bool)
    for _ in range(n):
        k = int(np.argmax(np.where(out, best, -1.0)))
        out[k] = False
        if best[k] < least:
            parent[k] = -1
        closer = out & (strength[k] > best)
        parent[closer], best[closer] = k, strength[k][closer]
    return parent


def label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of class 1; each voter's rates of firing in class 0 and 1; how much of each voter is its own: one over one
    and the sum of squared correlations, within classes, with those it depends on.

    The model: a hidden class; the given label, right with some probability; voters that form a forest, each firing with a
    probability that depends on the class and on whether its parent fires. Expectation maximisation estimates all of
    these; the forest is the one of the largest mutual information within classes (Chow and Liu), of which only edges
    count that chance does not explain. Starts at the given labels; rows that most voters contradict can change sides.
    """
    v, n = votes.astype(np.float64), votes.shape[1]
    q, own, rates = np.where(label == 1, 0.95, 0.05), np.ones(n), np.zeros((2, n))
    for _ in range(rounds):
        row = (weight * (1 - q), weight * q)
        many = np.array([r.sum() for r in row])
        both = [(v * r[:, None]).T @ v for r in row]
        rates = np.stack([(np.diag(j) + 0.1) / (m + 0.5) for j, m in zip(both, many, strict=True)])
        strength, squared = np.zeros((n, n)), np.zeros((n, n))
        for j, m, p in zip(both, many, rates, strict=True):
            joint = np.clip((j + 0.5 * np.outer(p, p)) / (m + 0.5), 1e-9, None)
            for x, y in ((joint, np.outer(p, p)), (p[:, None] - joint, np.outer(p, 1 - p)), (p[None] - joint, np.outer(1 - p, p)), (1 - p[:, None] - p[None] + joint, np.outer(1 - p, 1 - p))):
                x = np.clip(x, 1e-12, None)
                strength += 2 * m * x * np.log(x / np.clip(y, 1e-12, None))
            spread = p * (1 - p)
            squared += m / many.sum() * np.clip((joint - np.outer(p, p)) ** 2 / np.outer(spread, spread), 0, 1)
        parent = _tree(strength, EVIDENCE)
        edge = np.flatnonzero(parent >= 0)
        up = parent[edge]
        loads = np.zeros(n)
        np.add.at(loads, edge, squared[edge, up])
        np.add.at(loads, up, squared[edge, up])
        own = 1 / (1 + loads)
        z = np.zeros(len(v))
        pairs = v[:, edge] * v[:, up]
        for sign, j, m, p in zip((-1, 1), both, many, rates, strict=True):
            # A vote's log probability is const + a vote + b parent + c vote x parent; roots have no parent.
            fires, silent = np.log(p), np.log1p(-p)
            const, a, c = silent.copy(), fires - silent, np.zeros(len(edge))
            if len(edge):
                count = np.diag(j)[up]
                on = (j[edge, up] + p[edge]) / (count + 1)  # with the weight of one row drawn towards its own rate
                off = (np.diag(j)[edge] - j[edge, up] + p[edge]) / (m - count + 1)
                on, off = np.clip(on, 1e-6, 1 - 1e-6), np.clip(off, 1e-6, 1 - 1e-6)
                const[edge], a[edge] = np.log1p(-off), np.log(off) - np.log1p(-off)
                np.add.at(a, up, np.log1p(-on) - np.log1p(-off))
                c = np.log(on) - np.log1p(-on) - np.log(off) + np.log1p(-off)
            z += sign * (const.sum() + v @ a + pairs @ c + np.log(max(m, 1e-9)))
        right = (row[1] @ label + 1) / (many[1] + 1.2), (row[0] @ label + 0.2) / (many[0] + 1.2)
        z += np.where(label == 1, np.log(right[0] / right[1]), np.log((1 - right[0]) / (1 - right[1])))
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return q, rates, own


def linear(votes: np.ndarray, q: np.ndarray, weight: np.ndarray, penalty: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    x = np.hstack([votes.astype(np.float64), np.ones((len(votes), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - q)) + ridge * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


def voters_of(terms: list[int]) -> Model:
    """A model without weights: a voter for each mined term, each lexicon and each pattern."""
    of: dict[int, int] = {h: k for k, h in enumerate(terms)}
    names = [f"term_{h:016x}" for h in terms]
    for name, listed in LEXICONS.items():
        for word in listed:
            of.setdefault(_word_hash(word), len(names))
        names.append(name)
    names += PATTERNS
    known = np.array(sorted(of), U)
    return Model(known, np.array([of[int(h)] for h in known], np.int64), len(names), np.zeros(len(names)), 0.0, names)


def fit(model: Model, votes: np.ndarray, label: np.ndarray, share: dict[int, float]) -> Model:
    """Gives the model its weights. share: rows of the corpus that one sampled row of a class stands for. With labels of
    one class only there is nothing to learn from, and an insult speaks for itself."""
    if not len(label) or label.min() == label.max():
        model.weights, model.bias = np.array([4.0 * n.startswith(("insult", "contempt")) for n in model.names]), -3.0
        return model
    weight = np.array([share[int(y)] for y in label])
    q, _, _ = label_model(votes, label.astype(np.float64), weight)
    model.weights, model.bias = linear(votes, q, weight)
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` training rows of each class, picked by a hash of the id. Only labels outside the held-out
    third are read. Null labels and labels of absent documents do not count; of several labels of one id, the largest, and of
    several documents, the one with the least text."""
    known = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for y in (0, 1):
        some = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    texts = staged(labelled_texts(docs, picked, id_col, text_col), "labelled")  # at most 2 x sample rows, whatever is repeated
    taken = {y: 0 for y in (0, 1)} | {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    model = voters_of(mined(texts, taken[1], taken[0]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in slices(batch.column(1)):
                packed = np.packbits(model.votes(some), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array([v.tobytes() for v in packed], pa.binary())], ["toxic", "votes"])

    got = sorted((r["toxic"], bytes(r["votes"])) for r in texts.mapInArrow(vote, "toxic int, votes binary").collect())  # some 30 bytes a row
    packed = np.frombuffer(b"".join(v for _, v in got), np.uint8).reshape(len(got), -(-model.voters // 8))
    votes = np.unpackbits(packed, axis=1, count=model.voters).astype(bool) if got else np.zeros((0, model.voters), bool)
    return fit(model, votes, np.array([y for y, _ in got]), {y: max(1.0, counts.get(y, 0) / max(taken[y], 1)) for y in (0, 1)})


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' own columns and score (0 to 1), which replaces a column of that name. Null texts are empty; every row gets a score."""
    docs = docs.drop("score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            score = np.concatenate([np.zeros(0), *(model.score(x) for _, x in slices(texts))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more, with docs' own columns."""
    model = train(docs, labels, id_col, text_col)
    columns, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).fill_null("")
            score = np.concatenate([np.zeros(0), *(model.score(x) for _, x in slices(texts))])
            yield batch.filter(pa.array(score < threshold))

    return docs.select(*columns).mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
