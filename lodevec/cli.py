"""python -m lodevec.cli build-index | query | query-words | test"""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.operators import evaluate, index
from lodevec.plans.build import build
from lodevec.shared import ship
from lodevec.sources import word2vec


def whole(low: int, high: int | None = None):
    def check(text: str) -> int:
        n = int(text)
        if n < low or (high is not None and n > high):
            raise argparse.ArgumentTypeError(f"must be at least {low}" + (f" and at most {high}" if high else ""))
        return n

    return check


def share(text: str) -> float:
    x = float(text)
    if not x >= 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return x


def formatted_bytes(n: float) -> str:
    for unit in ("B", "kB", "MB", "GB", "TB"):
        if n < 1000 or unit == "TB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1000


def formatted_seconds(s: float) -> str:
    return f"{s * 1000:.0f} ms" if s < 1 else f"{s:.1f} s" if s < 60 else f"{int(s // 60)} min {int(s % 60)} s"


def bar(done: int, total: int, width: int = 30) -> str:
    full = width * min(done, total) // max(total, 1)
    return f"[{'#' * full}{' ' * (width - full)}] {100 * min(done, total) // max(total, 1):3d} %"


def told(task: str, done: int, total: int, note: str = "") -> None:
    """A line of progress: on a terminal it replaces the one before."""
    end = "\n" if not sys.stderr.isatty() or done >= total else ""
    print(f"{chr(13) + chr(27) + '[2K' if sys.stderr.isatty() else ''}{task} {bar(done, total)} {note}", end=end, file=sys.stderr, flush=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodevec")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build-index")
    b.add_argument("-d", "--metric", choices=index.METRICS, required=True)
    b.add_argument("-k", "--clusters", type=whole(1, 65536), default=256)
    b.add_argument("-m", "--sections", type=whole(1), default=25)
    b.add_argument("-n", "--iterations", type=whole(0), default=100)
    b.add_argument("-p", "--partitioned", action="store_true")
    b.add_argument("--partitions", type=whole(1))
    b.add_argument("-l", "--limit", type=whole(1))
    b.add_argument("-o", "--output", required=True)
    b.add_argument("vectors")
    for name in ("query", "query-words"):
        q = sub.add_parser(name)
        q.add_argument("-k", "--neighbours", type=whole(1), default=10)
        q.add_argument("-i", "--index", required=True)
        q.add_argument("input", nargs="?" if name == "query-words" else None)
    t = sub.add_parser("test")
    t.add_argument("-v", "--vectors", required=True)
    t.add_argument("-i", "--index", required=True)
    t.add_argument("-s", "--sample", type=whole(1), default=1000)
    t.add_argument("-e", "--epsilon", type=share, default=0.0)
    return top


def rate(done: int, seconds: float) -> float:
    return done / seconds if seconds > 0 else 0.0


def result_lines(results: DataFrame) -> DataFrame:
    """query_id and line: its neighbours' keys, nearest first, comma-joined."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"].cast("string"))
    return results.groupBy("query_id").agg(F.array_join(listed, ",").alias("line"))


def word_lines(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """key and line for every word asked for, found or not."""
    lines = result_lines(results)
    return wanted.join(lines, F.col("key") == F.col("query_id"), "left").select("key", F.coalesce("line", F.lit("not found")).alias("line"))


def run(args: argparse.Namespace, spark: SparkSession) -> None:
    began = time.time()
    if args.command == "build-index":
        if not args.partitioned and (args.partitions or args.limit):
            raise SystemExit("--partitions and --limit go with --partitioned")
        vectors = word2vec.read(spark, args.vectors)
        read = word2vec.reader_stats(vectors).first()
        logging.info("read %d vectors, %s in memory, in %s", read["n"], formatted_bytes(read["memory_bytes"]), formatted_seconds(time.time() - began))
        build(vectors, args.metric, args.clusters, args.sections, args.iterations, args.partitioned, args.partitions, args.limit, args.output, told)
        logging.info("built in %s", formatted_seconds(time.time() - began))
        return
    found = index.load(spark, args.index)
    if args.command == "query":
        queries = word2vec.read(spark, args.input).withColumnRenamed("key", "query_id")
        for r in result_lines(found.query(queries, args.neighbours)).toLocalIterator():
            print(f"{r['query_id']}: {r['line']}")
    elif args.command == "query-words":
        wanted = word2vec.words(spark, args.input)
        for r in word_lines(wanted, found.query_by_key(wanted, args.neighbours)).toLocalIterator():
            print(f"{r['key']}: {r['line']}")
    else:
        vectors = word2vec.read(spark, args.vectors).persist()
        queries = evaluate.sample(vectors, args.sample).persist()
        truths = evaluate.truth(queries, vectors, metric=found.metric).persist()
        told("truth", truths.select("query_id").distinct().count(), args.sample)
        asked = time.time()
        results = found.query(queries, max(evaluate.KS)).persist()
        done = results.select("query_id").distinct().count()
        told("queries", done, args.sample, f"{rate(done, time.time() - asked):.1f} queries a second")
        evaluate.report(evaluate.recall(results, queries, vectors, truths, args.epsilon, found.metric))
        for df in (results, truths, queries, vectors):
            df.unpersist()


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, stream=sys.stderr)
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodevec").getOrCreate()
    ship(spark)
    run(args, spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
