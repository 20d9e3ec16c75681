"""Best-fit packing of documents into sequences under several capacities at once.

A sequence has room for so many tokens, documents and attention cost (the sum of its items' squared lengths). An item's
length decides its needs in all three, so items of one length are interchangeable, and packing works on the histogram of
lengths: at most `capacity` numbers, however many documents there are. The driver runs vector best-fit on it, longest
items first: of the open bins whose residuals all suffice, an item goes to the one with the best score, which is the
smallest weighted norm of what would remain ("norm") or the largest weighted dot product of need and residual ("dot");
residuals and needs count in shares of the capacities. Bins with equal residuals are handled together, so the plan is a
short list of intervals: items of this length with ranks a to b go to bins c to c + (b - a) at this offset. It is what
best-fit gives that places one item after the other.

Spark ranks the items of each length: places within a task are written down as documents are tokenised, the tasks' counts
are added up and joined back by (length, task), and every item looks its interval up by binary search. No group of items
is gathered: the join's keys are bounded by a task's pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import staged, table, text_or_empty

CAPACITY, END_ID = 1024, 2
#: What a sequence may hold besides its tokens: documents, and the sum of squared lengths (two items never have it if
#: the longer one has 1,010 tokens or more); the weights of tokens, documents and attention cost in the score.
DOCUMENTS, ATTENTION, WEIGHTS = 64, 1010**2, (1.0, 0.25, 0.25)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


class _Open:
    """Open bins, grouped by what is left in them; the numbers of a group's bins are kept as (first, how many)."""

    def __init__(self):
        self.left, self.used = np.zeros((64, 3), np.int64), 0
        self.row: dict[tuple[int, ...], int] = {}
        self.bins: dict[int, list[tuple[int, int]]] = {}
        self.free: list[int] = []

    def add(self, left: tuple[int, ...], first: int, many: int) -> None:
        if many <= 0 or min(left) <= 0:
            return
        if left not in self.row:
            if not self.free:
                if self.used == len(self.left):
                    self.left = np.concatenate([self.left, np.zeros_like(self.left)])
                self.free.append(self.used)
                self.used += 1
            k = self.row[left] = self.free.pop()
            self.left[k], self.bins[k] = left, []
        self.bins[self.row[left]].append((first, many))

    def take(self, k: int) -> tuple[tuple[int, ...], int, int]:
        """Some bins of a group: what is left in each, the first one's number, how many."""
        left = tuple(self.left[k].tolist())
        first, many = self.bins[k].pop()
        if not self.bins[k]:
            del self.bins[k], self.row[left]
            self.left[k] = 0
            self.free.append(k)
        return left, first, many

    def best(self, need: np.ndarray, scale: np.ndarray, score: str) -> int | None:
        """The group with the best score of those that need fits into; of equal ones the one with the least left."""
        left = self.left[: self.used]
        fits = np.flatnonzero((left >= need).all(axis=1))
        if not len(fits):
            return None
        some = left[fits]
        bad = -(some * need * scale).sum(axis=1) if score == "dot" else ((some - need) ** 2 * scale).sum(axis=1)
        least = fits[bad == bad.min()]
        return int(least[np.lexsort(left[least].T[::-1])[0]])


def plan(counts: dict[int, int], capacity: int = CAPACITY, documents: int | None = DOCUMENTS, attention: int | None = ATTENTION, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> list[tuple[int, int, int, int, int]]:
    """counts: items by length, each 1 to capacity -> intervals (length, first rank, items, first bin, offset).

    No limit of documents or attention means what tokens alone allow. An item that exceeds a capacity on its own gets a
    bin of its own. weights are not negative.
    """
    caps = np.array([capacity, documents or capacity, attention or capacity * capacity], np.int64)
    scale = np.asarray(weights, np.float64) / caps.astype(np.float64) ** 2
    open_, out, bins = _Open(), [], 0
    for length in sorted(counts, reverse=True):
        need, rank = np.array([length, 1, length * length], np.int64), 0
        alone = bool((need > caps).any())
        while rank < counts[length]:
            todo = counts[length] - rank
            k = None if alone else open_.best(need, scale, score)
            if k is None:
                left, each = tuple(caps.tolist()), 1 if alone else int((caps // need).min())
                first, many = bins, -(-todo // each)
                bins += many
            else:
                left, first, many = open_.take(k)
                # By norm, a bin that has just been given an item is still the best one; by dot product, its like are.
                each = 1 if score == "dot" else min(a // b for a, b in zip(left, need.tolist(), strict=True))
            full = min(many, todo // each)
            rest = min(todo - full * each, each - 1) if full < many else 0
            for at, n, deep in ((first, full, each), (first + full, 1, rest)):
                for j in range(deep if n else 0):
                    out.append((length, rank, n, at, capacity - left[0] + j * length))
                    rank += n
                if deep:
                    open_.add(tuple(a - deep * b for a, b in zip(left, need.tolist(), strict=True)), at, n)
            begun = full + (rest > 0)
            open_.add(left, first + begun, many - begun)
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, text -> PIECES: each document's ids and end_id, in pieces of capacity ids of which the first may be
    shorter. part and place number the pieces of each length within their task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lodevec.llm.tokens import ids_for

        ids, part = ids_for(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                whole = np.append(ids.encode([text.as_py()])[0], np.uint32(end_id)).astype("<u4", copy=False)
                head = len(whole) % capacity
                edges = [0, *range(head or capacity, len(whole) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append((name.as_py(), k, a, b - a, zlib.crc32(whole[a:b].data)))
            if not rows:
                continue
            cols = list(zip(*rows, strict=True))
            length = np.array(cols[3], np.int64)
            order = np.argsort(length, kind="stable")
            many = np.bincount(length, minlength=capacity + 1)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - (np.cumsum(many) - many)[length[order]]
            place += seen[length]
            seen += many
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            arrays += [pa.array(np.full(len(rows), part, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece of one id; a repeated row is packed as often as it occurs; an empty table gives no
    rows; very long texts are cut and only their first piece shares a sequence; columns other than id_col and text_col
    are not looked at. path: a byte-level BPE tokenizer file, readable on every executor. how: plan()'s capacities,
    weights and score.
    """
    cut = staged(pieces(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), path, capacity, end_id), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = by_part.select("length", "part", F.expr("coalesce(sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    planned = np.array(plan(counts, capacity, **how), np.int64).reshape(-1, 5)
    planned = planned[np.lexsort((planned[:, 1], planned[:, 0]))]
    order, shift = planned[:, 0] * (1 << 50) + planned[:, 1], np.int64(1 << 50)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = (b["base"] + b["place"]).to_numpy()
            k = np.searchsorted(order, b["length"].to_numpy() * shift + rank, "right") - 1
            b["sequence_id"] = planned[k, 3] + rank - planned[k, 1]
            b["offset"] = planned[k, 4]
            yield b.drop(columns=["base", "place", "part"])

    rows = cut.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "base")
    return rows.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
