"""Product quantisation: one k-means for each section of the vectors, all sections in one pass a round."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.functions.vectors import split_ranges
from lodevec.operators import kmeans
from lodevec.operators.arrays import fingerprint, hashes, lists, matrix, nearest, summed
from lodevec.operators.stats import Summary

# The code widths in bits that packing supports.
WIDTHS = (0, 2, 4, 8, 10, 12, 16)


def code_width(clusters: int) -> int:
    """Bits of a code for so many clusters."""
    if not 1 <= clusters <= 1 << 16:
        raise ValueError(f"clusters must be 1 to 65536, not {clusters}")
    need = (clusters - 1).bit_length()
    return next(w for w in WIDTHS if w >= need)


def pack(codes: np.ndarray, width: int) -> bytes:
    """Codes below 2^width as bytes: whole high bytes first where the width passes 8, then the low bits, the first code
    in the lowest bits of its byte."""
    return pack_rows(np.asarray(codes, np.int64)[None], width)[0].tobytes()


def unpack(data: bytes, width: int, length: int) -> np.ndarray:
    if width not in WIDTHS:
        raise ValueError(f"no such width: {width}")
    if len(data) != packed_size(width, length):
        raise ValueError("the data's length does not fit")
    return unpack_rows(np.frombuffer(data, np.uint8)[None], width, length)[0]


def pack_rows(codes: np.ndarray, width: int) -> np.ndarray:
    """rows x codes -> rows x bytes, each row as pack() does it."""
    if width not in WIDTHS:
        raise ValueError(f"no such width: {width}")
    rows, length = codes.shape
    if codes.size and (codes.min() < 0 or codes.max() >> width):
        raise ValueError("a code is out of range")
    low = width - 8 if width > 8 else width
    high = (codes >> low).astype(np.uint8) if width > 8 else np.zeros((rows, 0), np.uint8)
    if low == 0:
        return high
    each = 8 // low
    rest = np.zeros((rows, -(-length // each) * each), np.int64)
    rest[:, :length] = codes & ((1 << low) - 1)
    return np.concatenate([high, (rest.reshape(rows, -1, each) << (np.arange(each) * low)).sum(axis=2).astype(np.uint8)], axis=1)


def unpack_rows(data: np.ndarray, width: int, length: int) -> np.ndarray:
    """rows x bytes -> rows x length codes."""
    if width == 0:
        return np.zeros((len(data), length), np.int64)
    raw = data.astype(np.int64)
    low = width - 8 if width > 8 else width
    high, rest = (raw[:, :length], raw[:, length:]) if width > 8 else (np.zeros((len(raw), length), np.int64), raw)
    each = 8 // low
    parts = (rest[:, :, None] >> (np.arange(each) * low)) & ((1 << low) - 1)
    return (high << low) + parts.reshape(len(raw), -1)[:, :length]


def packed_size(width: int, length: int) -> int:
    low = width - 8 if width > 8 else width
    return (length if width > 8 else 0) + -(-length * low // 8)


@dataclass
class Report:
    """A round of training: sections that are done, and how far centroids moved in the others."""

    iteration: int
    most: int
    done: int
    sections: int
    step: Summary


@dataclass
class ProductQuantizer:
    ranges: list[tuple[int, int]]
    centroids: list[np.ndarray]  # for each section, clusters x its length

    @property
    def clusters(self) -> int:
        return len(self.centroids[0])

    @property
    def dimension(self) -> int:
        return sum(n for _, n in self.ranges)

    @property
    def width(self) -> int:
        return code_width(self.clusters)

    def encode_rows(self, x: np.ndarray) -> np.ndarray:
        return np.stack([nearest(x[:, b : b + n], c)[0] if n else np.zeros(len(x), np.int64) for (b, n), c in zip(self.ranges, self.centroids, strict=True)], axis=1)

    def decode_rows(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centroids)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x sections x clusters: squared distances of each query's sections to the centroids."""
        return np.stack([((q[:, None, b : b + n] - c[None]) ** 2).sum(axis=2) for (b, n), c in zip(self.ranges, self.centroids, strict=True)], axis=1)

    def encode(self, vectors: DataFrame, packed: bool = False) -> DataFrame:
        """vectors with codes in the place of vector: array<int>, or packed into bytes."""
        names, at, me = vectors.columns, vectors.columns.index("vector"), self
        kind = "binary" if packed else "array<int>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = me.encode_rows(matrix(b.column(at), me.dimension))
                column = me.packed(codes) if packed else lists(codes.astype(np.int32))
                yield pa.RecordBatch.from_arrays([column if i == at else b.column(i) for i in range(len(names))], ["codes" if n == "vector" else n for n in names])

        schema = ", ".join(f"codes {kind}" if n == "vector" else f"`{n}` {t}" for n, t in vectors.dtypes)
        return vectors.mapInArrow(run, schema)

    def packed(self, codes: np.ndarray) -> pa.Array:
        return pa.array([r.tobytes() for r in pack_rows(codes.astype(np.int64), self.width)], pa.binary())

    def unpacked(self, column: pa.Array) -> np.ndarray:
        """rows x sections codes of a column of either kind."""
        m = len(self.ranges)
        if pa.types.is_list(column.type):
            return matrix(column, m).astype(np.int64)
        size = packed_size(self.width, m)
        data = b"".join(column.to_pylist())
        if len(data) != size * len(column):
            raise ValueError("the data's length does not fit")
        return unpack_rows(np.frombuffer(data, np.uint8).reshape(len(column), size), self.width, m)

    def decode(self, codes: DataFrame) -> DataFrame:
        """codes (of either kind) with vector array<double> in the place of codes."""
        names, at, me = codes.columns, codes.columns.index("codes"), self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = lists(me.decode_rows(me.unpacked(b.column(at))))
                yield pa.RecordBatch.from_arrays([x if i == at else b.column(i) for i in range(len(names))], ["vector" if n == "codes" else n for n in names])

        schema = ", ".join("vector array<double>" if n == "codes" else f"`{n}` {t}" for n, t in codes.dtypes)
        return codes.mapInArrow(run, schema)

    def error(self, vectors: DataFrame) -> float:
        """Sum of squared distances of vectors to their reconstructions."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                x = matrix(b.column(0), me.dimension)
                total += float(((x - me.decode_rows(me.encode_rows(x))) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["error"])

        return float(vectors.select("vector").mapInArrow(run, "error double").agg(F.sum("error")).first()[0] or 0.0)

    def frame(self, spark: SparkSession) -> DataFrame:
        """The codebook: quantizer, from, dim, code, centroid."""
        rows = [(i, b, n, k, [float(v) for v in c[k]]) for i, ((b, n), c) in enumerate(zip(self.ranges, self.centroids, strict=True)) for k in range(len(c))]
        return spark.createDataFrame(rows, "quantizer int, `from` int, dim int, code int, centroid array<double>")

    @classmethod
    def of_frame(cls, codebook: DataFrame) -> ProductQuantizer:
        rows = sorted(codebook.collect(), key=lambda r: (r["quantizer"], r["code"]))  # sections x clusters rows
        if not rows:
            raise ValueError("an empty codebook")
        m = rows[-1]["quantizer"] + 1
        of = [[r for r in rows if r["quantizer"] == i] for i in range(m)]
        return cls([(rs[0]["from"], rs[0]["dim"]) for rs in of], [np.array([r["centroid"] for r in rs], np.float64).reshape(len(rs), rs[0]["dim"]) for rs in of])


def train(vectors: DataFrame, sections: int, clusters: int, iterations: int = 100, order: str = "key", start: ProductQuantizer | None = None, report: Callable[[Report], None] | None = None) -> ProductQuantizer:
    """Section i starts from rows drawn with seed i. Each section stops when none of its codes change, all after
    iterations + 1 updates."""
    code_width(clusters)
    if start is None:
        first = vectors.select("vector").first()
        if first is None:
            raise ValueError("no vectors")
        d, n = len(first["vector"]), vectors.count()
        ranges = split_ranges(d, sections)
        picks = [kmeans.sample_rows(n, clusters, seed) for seed in range(sections)]
        rows = kmeans.pick_rows(vectors, [p for ps in picks for p in ps], order)
        start = ProductQuantizer(ranges, [np.array([rows[p][b : b + w] for p in ps], np.float64).reshape(clusters, w) for (b, w), ps in zip(ranges, picks, strict=True)])
    ranges, now, last = start.ranges, start.centroids, None
    d = start.dimension
    done = [w == 0 for _, w in ranges]
    for i in range(iterations + 1):
        total, many, who = _sums(vectors, ProductQuantizer(ranges, now), d, done)
        done = [was or (last is not None and a == b) for was, a, b in zip(done, who, last or who, strict=True)]
        new = [c if stop else kmeans.means(t, n) for c, stop, t, n in zip(now, done, total, many, strict=True)]
        if report:
            moved = [Summary(len(c), *kmeans.step_size(c, n)) for c, n, stop in zip(now, new, done, strict=True) if not stop]
            report(Report(i, iterations, sum(done), len(done), sum((Summary(m.count, m.mean, m.deviations**2 * m.count) for m in moved), Summary())))
        if all(done):
            break
        last, now = who, new
    return ProductQuantizer(ranges, now)


def _sums(vectors: DataFrame, new: ProductQuantizer, d: int, done: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
    """For each section, sums and numbers by cluster, and a number that says which vector has which code. Sections that are
    done are skipped."""
    k = [len(c) for c in new.centroids]

    def count(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        total, many, who = [np.zeros(c.shape) for c in new.centroids], [np.zeros(n, np.int64) for n in k], np.zeros(len(k), np.uint64)
        for b in batches:
            x = matrix(b.column(0), d)
            hashed = hashes(x)
            for i, (at, w) in enumerate(new.ranges):
                if done[i]:
                    continue
                part = np.ascontiguousarray(x[:, at : at + w])
                index, _ = nearest(part, new.centroids[i])
                total[i] += summed(index, part, k[i])
                many[i] += np.bincount(index, minlength=k[i])
                who[i : i + 1] += fingerprint(hashed, index)
        return [*total, *many, who]

    *found, who = kmeans.tally(vectors.select("vector"), count)
    return found[: len(k)], found[len(k) :], who.tolist()
