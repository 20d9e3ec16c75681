"""Compressed indices: flat (every code is scanned) and partitioned (only the nearest clusters' codes are)."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodevec.operators import knn, pq
from lodevec.operators.arrays import CELLS, Best, distances, keys_of, lists, matrix, offer, unit
from lodevec.operators.kmeans import KMeans

METRICS = ("l2", "cosine")

#: Bytes of a flat index that go to all executors; queries that a task answers at once; codes that it decodes at once.
SENT, ANSWERED, DECODED = 1 << 26, 2048, 1 << 14


@dataclass(frozen=True)
class LimitGroups:
    """Probe the n nearest clusters."""

    n: int


@dataclass(frozen=True)
class LimitVectors:
    """Probe the nearest clusters until they hold n vectors; none if n is 0."""

    n: int


def _asked(q: np.ndarray, metric: str) -> np.ndarray:
    return unit(q) if metric == "cosine" else q


def _adc(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """queries x rows: sums of table entries at the rows' codes, a section at a time; a code's entries for all queries lie
    together."""
    out = np.zeros((len(codes), len(tables)))
    for s in range(codes.shape[1]):
        out += np.ascontiguousarray(tables[:, s].T)[codes[:, s]]
    return out.T


def _score(best: Best, quantizer: pq.ProductQuantizer, asked: np.ndarray, q: np.ndarray, codes: np.ndarray, keys: np.ndarray) -> None:
    """Offers rows' codes to the queries asked, whose vectors are q, some queries at a time."""
    step = max(1, CELLS // max(1, len(codes), quantizer.clusters * len(quantizer.ranges)))
    for at in range(0, len(asked), step):
        best.add(asked[at : at + step], _adc(quantizer.tables(q[at : at + step]), codes), keys)


class Index:
    """What both kinds share: size, dimension, keys, lookup by key, queries by key."""

    quantizer: pq.ProductQuantizer
    codes: DataFrame  # with the column codes packed
    metric: str

    @property
    def dimension(self) -> int:
        return self.quantizer.dimension

    def size(self) -> int:
        return self.codes.count()

    def keys(self) -> DataFrame:
        return self.codes.select("key")

    def reconstruct(self) -> DataFrame:
        """Every row's key (and partition) and vector."""
        return self.decoded(self.codes)

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError

    #: What decides between several rows of one key: the first of these is found.
    order: tuple[str, ...] = ("codes",)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """wanted: key -> key, vector (null if absent). Of several rows of a key the first one counts: that of the lowest
        partition, then of the least codes."""
        some = self.codes.join(wanted.select("key").distinct(), "key", "left_semi")
        first = some.groupBy("key").agg(F.min(F.struct(*self.order)).alias("x")).select("key", "x.*")
        return wanted.join(self.decoded(first).select("key", "vector"), "key", "left")

    def decoded(self, codes: DataFrame) -> DataFrame:
        """codes' rows with their reconstructed vector."""
        raise NotImplementedError

    def query_by_key(self, wanted: DataFrame, k: int) -> DataFrame:
        """query_id is the key; keys that are absent give no rows. The key itself is among its neighbours."""
        at = self.lookup(wanted.select("key").distinct()).where("vector IS NOT NULL")
        return self.query(at.select(F.col("key").alias("query_id"), "vector"), k)


class FlatPQIndex(Index):
    """codes: key, codes (packed, binary), in the order of keys within each file."""

    def __init__(self, codes: DataFrame, quantizer: pq.ProductQuantizer, metric: str = "l2"):
        if metric not in METRICS:
            raise ValueError(f"no such metric: {metric}")
        self.codes, self.quantizer, self.metric = codes, quantizer, metric

    @classmethod
    def build(cls, vectors: DataFrame, quantizer: pq.ProductQuantizer, metric: str = "l2") -> FlatPQIndex:
        """vectors: key, vector; under cosine they are to be of unit length already."""
        return cls(quantizer.encode(vectors.select("key", "vector"), packed=True), quantizer, metric)

    def decoded(self, codes: DataFrame) -> DataFrame:
        return self.quantizer.decode(codes.select("key", "codes"))

    def query(self, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
        """queries: query_id, vector -> query_id, rank, key, distance (squared, to the reconstructions).

        Up to SENT bytes of codes and keys go to all executors, where each query is answered at once, so nothing is
        shuffled but queries. A larger index stays where it is, and queries go there in blocks."""
        quantizer = self.quantizer
        key_type, id_type = knn.types_of(queries, self.codes)
        if block is None and (held := self._held(key_type)) is not None:
            return self._answered(queries, k, held, key_type, id_type)

        def feed(best: Best, q: np.ndarray, batch: pa.RecordBatch) -> None:
            _score(best, quantizer, np.arange(len(q)), q, quantizer.unpacked(batch.column(1)), keys_of(batch.column(0)))

        parts = [knn.scan(self.codes, ["key", "codes"], ids, _asked(q, self.metric), k, key_type, id_type, feed) for ids, q in knn.query_blocks(queries, k, block)]
        return knn.together(parts, queries.sparkSession, id_type, key_type)

    def _held(self, key_type: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys and packed codes, if they are SENT bytes at most, with 8 bytes for a number and what Python takes for others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((keys_of(b.column(0)), b"".join(b.column(1).to_pylist())))], pa.binary())], ["rows"])

        size, codes = pq.packed_size(self.quantizer.width, len(self.quantizer.ranges)), self.codes.select("key", "codes")
        each = F.octet_length("key") * 2 + 64 if key_type == "string" else F.lit(8)
        n, keys = codes.agg(F.count(F.lit(1)), F.sum(each)).first()
        if not n or n * size + keys > SENT:
            return None
        found = [pickle.loads(r["rows"]) for r in codes.mapInArrow(run, "rows binary").collect()]
        return np.concatenate([f[0] for f in found]), np.frombuffer(b"".join(f[1] for f in found), np.uint8).reshape(n, size)

    def _answered(self, queries: DataFrame, k: int, held: tuple[np.ndarray, np.ndarray], key_type: str, id_type: str) -> DataFrame:
        quantizer, metric, m = self.quantizer, self.metric, len(self.quantizer.ranges)
        context = self.codes.sparkSession.sparkContext
        sent = context.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, codes = sent.value
            for b in batches:
                for at in range(0, b.num_rows, ANSWERED):
                    ids = b.column(0).slice(at, ANSWERED)
                    q = _asked(matrix(b.column(1).slice(at, ANSWERED), quantizer.dimension), metric)
                    best = Best(len(q), k)
                    for to in range(0, len(codes), DECODED):
                        x = quantizer.decode_rows(pq.unpack_rows(codes[to : to + DECODED], quantizer.width, m))
                        offer(best, q, x, keys[to : to + DECODED])
                    i, key, d = best.rows()
                    rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(rank.astype(np.int32)), pa.array(key.tolist(), knn.arrow_type(key_type)), pa.array(d, pa.float64())], ["query_id", "rank", "key", "distance"])

        few = queries.select("query_id", "vector").repartition(max(context.defaultParallelism, -(-queries.count() // ANSWERED)))
        return few.mapInArrow(run, f"query_id {id_type}, rank int, key {key_type}, distance double")

    def save(self, path: str) -> None:
        self.codes.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/codes")
        self.quantizer.frame(self.codes.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
        _write_meta(self.codes.sparkSession, path, {"kind": "flat", "metric": self.metric})


@dataclass(frozen=True)
class _Probes:
    """Which clusters each query probes; small enough to go with a task."""

    centroids: np.ndarray
    sizes: np.ndarray
    strategy: LimitGroups | LimitVectors

    def __call__(self, q: np.ndarray) -> list[np.ndarray]:
        step, out = max(1, CELLS // self.centroids.size), []
        for at in range(0, len(q), step):
            d = np.round(distances(q[at : at + step], self.centroids), 9)
            order = np.argsort(d, axis=1, kind="stable")
            if isinstance(self.strategy, LimitGroups):
                out += list(order[:, : max(self.strategy.n, 0)])
            else:
                held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
                out += [o[h < self.strategy.n] for o, h in zip(order, held, strict=True)]
        return out


class IVFPQIndex(Index):
    """codes: partition, key, codes (packed, binary) of the residuals; clusters: the non-empty coarse centroids. A saved
    index is laid out by partition and sorted by key, so queries read the files of the partitions they probe; one that
    was only built encodes all vectors again for each query."""

    order = ("partition", "codes")

    def __init__(self, codes: DataFrame, quantizer: pq.ProductQuantizer, clusters: dict[int, np.ndarray], sizes: dict[int, int], metric: str = "l2", strategy: LimitGroups | LimitVectors = LimitGroups(5)):
        if metric not in METRICS:
            raise ValueError(f"no such metric: {metric}")
        if not clusters:
            raise ValueError("an index needs vectors")
        self.codes, self.quantizer, self.metric, self.strategy = codes, quantizer, metric, strategy
        self.partitions = sorted(clusters)
        self.centroids = np.array([clusters[p] for p in self.partitions])
        self.sizes = np.array([sizes[p] for p in self.partitions])

    @classmethod
    def build(cls, grouped_: DataFrame, quantizer: pq.ProductQuantizer, coarse: KMeans, metric: str = "l2", strategy: LimitGroups | LimitVectors = LimitGroups(5)) -> IVFPQIndex:
        """grouped_: partition, key, vector as grouped() gives them; quantizer: trained on their residuals."""
        sizes = {r["partition"]: r["count"] for r in grouped_.groupBy("partition").count().collect()}  # at most k rows
        codes = quantizer.encode(residuals(grouped_, coarse).select("partition", "key", "vector"), packed=True)
        return cls(codes, quantizer, {p: coarse.centroids[p] for p in sizes}, sizes, metric, strategy)

    def probes(self, q: np.ndarray) -> list[np.ndarray]:
        """For each query the places of the clusters to probe, nearest first (ties to the lowest)."""
        return _Probes(self.centroids, self.sizes, self.strategy)(q)

    def probe_frame(self, queries: DataFrame) -> DataFrame:
        """query_id, partition, probe_rank (from 1) of each query, made where the queries are."""
        id_type, dimension = dict(queries.dtypes)["query_id"], self.centroids.shape[1]
        metric, partitions = self.metric, np.array(self.partitions)
        probes = _Probes(self.centroids, self.sizes, self.strategy)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = probes(_asked(matrix(b.column(1), dimension), metric))
                many = [len(p) for p in found]
                at = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
                rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in many)]) + 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(many)), many))), pa.array(partitions[at].astype(np.int32)), pa.array(rank.astype(np.int32))], ["query_id", "partition", "probe_rank"])

        return queries.select("query_id", "vector").mapInArrow(run, f"query_id {id_type}, partition int, probe_rank int")

    def decoded(self, codes: DataFrame) -> DataFrame:
        c = {p: self.centroids[i] for i, p in enumerate(self.partitions)}
        quantizer = self.quantizer
        codes = codes.select("partition", "key", "codes")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = quantizer.decode_rows(quantizer.unpacked(b.column(2)))
                x = x + np.array([c[p] for p in b.column(0).to_pylist()]).reshape(x.shape)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(x)], ["partition", "key", "vector"])

        return codes.mapInArrow(run, f"partition int, key {dict(codes.dtypes)['key']}, vector array<double>")

    def query(self, queries: DataFrame, k: int, block: int | None = None) -> DataFrame:
        """Only partitions that some query of the block probes are read; a row is scored for the queries that probe its
        partition, by tables of the query's residual to the partition's centroid."""
        quantizer, centroids, probes = self.quantizer, self.centroids, _Probes(self.centroids, self.sizes, self.strategy)
        key_type, id_type = knn.types_of(queries, self.codes)
        place = {p: i for i, p in enumerate(self.partitions)}

        def feed(best: Best, asked: tuple[np.ndarray, dict[int, np.ndarray]], batch: pa.RecordBatch) -> None:
            (q, by), part = asked, batch.column(2).to_numpy(zero_copy_only=False)
            codes, keys = quantizer.unpacked(batch.column(1)), keys_of(batch.column(0))
            for p in np.unique(part):
                at, here = by[int(p)], part == p
                _score(best, quantizer, at, q[at] - centroids[place[int(p)]], codes[here], keys[here])

        parts = []
        for ids, q in knn.query_blocks(queries, k, block):
            q = _asked(q, self.metric)
            found = probes(q)
            who, where = np.repeat(np.arange(len(q)), [len(p) for p in found]), np.concatenate(found)
            by = {self.partitions[int(i)]: who[where == i] for i in np.unique(where)}
            wanted = self.codes.where(F.col("partition").isin(sorted(by)))
            parts.append(knn.scan(wanted, ["key", "codes", "partition"], ids, (q, by), k, key_type, id_type, feed))
        return knn.together(parts, queries.sparkSession, id_type, key_type)

    def save(self, path: str) -> None:
        spark = self.codes.sparkSession
        # A cluster's rows are a few tasks' work, by size: Spark splits large partitions of such an exchange.
        self.codes.hint("rebalance", "partition").sortWithinPartitions("partition", "key").write.mode("overwrite").partitionBy("partition").parquet(f"{path}/codes")
        self.quantizer.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
        rows = [(int(p), [float(x) for x in c], int(n)) for p, c, n in zip(self.partitions, self.centroids, self.sizes, strict=True)]
        spark.createDataFrame(rows, "partition int, centroid array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        kind = "groups" if isinstance(self.strategy, LimitGroups) else "vectors"
        _write_meta(spark, path, {"kind": "partitioned", "metric": self.metric, "strategy": kind, "limit": self.strategy.n})


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> FlatPQIndex | IVFPQIndex:
    """An index that save() wrote; anything else in its description is an error."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    quantizer = pq.ProductQuantizer.of_frame(spark.read.parquet(f"{path}/codebook"))
    codes = spark.read.parquet(f"{path}/codes")
    if meta.get("kind") == "flat":
        return FlatPQIndex(codes, quantizer, meta.get("metric"))
    limits = {"groups": LimitGroups, "vectors": LimitVectors}
    if meta.get("kind") != "partitioned" or meta.get("strategy") not in limits:
        raise ValueError(f"not an index this version reads: {meta}")
    rows = spark.read.parquet(f"{path}/centroids").collect()
    return IVFPQIndex(codes, quantizer, {r["partition"]: np.array(r["centroid"]) for r in rows}, {r["partition"]: r["n"] for r in rows}, meta.get("metric"), limits[meta["strategy"]](meta["limit"]))


def grouped(vectors: DataFrame, coarse: KMeans) -> DataFrame:
    """vectors: key, vector -> partition, key, vector, laid out by partition and sorted by key within each task. Spark splits
    what a large cluster has among tasks (rebalance); nothing here needs a cluster in one place."""
    rows = coarse.assign(vectors.select("key", "vector"), "partition").select("partition", "key", "vector")
    return rows.hint("rebalance", "partition").sortWithinPartitions("partition", "key")


def bounds(grouped_: DataFrame) -> DataFrame:
    """partition, begin, end: the rows of each partition (from 0, end exclusive) when partitions lie one after the other."""
    sizes = grouped_.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    ends = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, 0)  # a row for each partition
    return sizes.withColumn("end", F.sum("n").over(ends)).select("partition", (F.col("end") - F.col("n")).alias("begin"), "end")


def residuals(grouped_: DataFrame, coarse: KMeans) -> DataFrame:
    """grouped_ with each vector less its partition's centroid."""
    c, names = coarse.centroids, grouped_.columns
    at, part = names.index("vector"), names.index("partition")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(at), c.shape[1]) - c[b.column(part).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([lists(x) if i == at else b.column(i) for i in range(len(names))], names)

    schema = ", ".join("vector array<double>" if n == "vector" else f"`{n}` {t}" for n, t in grouped_.dtypes)
    return grouped_.mapInArrow(run, schema)

