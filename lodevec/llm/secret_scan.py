"""Secret scan with multipart credential linking, in DataFrame operations only.

Strong patterns (assign, access, hex) are reported wherever they match. Weak candidates, an account name, a long mixed
string, an address of a service, mean little alone: they are reported only if a complementary part lies within the same
scope, found by an interval join of a document's parts on cells as wide as the scope. The join is a semi join, so it
makes no pairs; a part is in each cell it has code points of, so what it compares is bounded by how many parts touch a
candidate's cells and those next to them.

Positions are in code points. A match's position is the summed length of what split() leaves before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import staged, table, text_or_empty

# The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# The weak patterns.
ACCOUNT = r"""(?i:\b(client_?id|access_?key_?id|account_?id|user_?name|user|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]{3,})"""
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"\b(?:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.:@_-]+"

KINDS = ["assign", "access", "hex", "account", "mixed", "endpoint"]
PATTERNS = dict(zip(KINDS, [ASSIGN, ACCESS, HEX, ACCOUNT, MIXED, ENDPOINT], strict=True))
LEAST_VALUE = 6
SCOPE = 400
#: What role a part plays, and which roles complete a weak candidate.
ROLE = {"access": "identifier", "account": "identifier", "assign": "secret", "hex": "secret", "mixed": "secret", "endpoint": "endpoint"}
COMPLETES = {"account": ["secret"], "mixed": ["identifier", "endpoint"], "endpoint": ["secret"]}

SPAN = "STRUCT<start: INT, end: INT>"
NO_SPANS = f"CAST(array() AS ARRAY<{SPAN}>)"
#: Matches whose places are added up before they are put aside: appending one by one to one array would take time that
#: grows with the square of their number.
TOGETHER = 64


def _spans(text: Column, pattern: str, matches: Column) -> Column:
    """[start, end) of each match, left to right."""
    before = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(before, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("long")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / TOGETHER).cast("int")), lambda k: F.slice(steps, k * TOGETHER + 1, F.lit(TOGETHER)))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + s["long"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("spans"))

    def add_block(acc: Column, block: Column) -> Column:
        some = F.aggregate(block, F.struct(acc["at"].alias("at"), F.expr(NO_SPANS).alias("spans")), add)
        return F.struct(some["at"].alias("at"), F.concat(acc["blocks"], F.array(some["spans"])).alias("blocks"))

    zero = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS ARRAY<ARRAY<{SPAN}>>)").alias("blocks"))
    return F.when(F.size(matches) > 0, F.flatten(F.aggregate(blocks, zero, add_block)["blocks"])).otherwise(F.expr(NO_SPANS))


def parts_of(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """keep's columns, and for each kind an array of [start, end) under the kind's name; null texts are empty."""
    text = docs.select(*keep, text_or_empty(text_col).alias("_text"))
    found = text.select("*", *(F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_{k}") for k, p in PATTERNS.items()))
    at = found.select("*", *(_spans(F.col("_text"), p, F.col(f"_{k}")).alias(k) for k, p in PATTERNS.items()))
    long = F.transform(F.col("_assign"), lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE)
    strong = F.filter(F.zip_with("assign", long, lambda s, ok: F.struct(s["start"].alias("start"), s["end"].alias("end"), ok.alias("ok"))), lambda s: s["ok"])
    kept = F.transform(strong, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return at.withColumn("assign", kept).drop("_text", *(f"_{k}" for k in KINDS))


def _of_kind(kind: str) -> Column:
    rank, name = F.lit(KINDS.index(kind)), F.lit(kind)
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), name.alias("kind")))


def _listed(kinds: list[str]) -> Column:
    """All spans of the kinds: start, order of the kind, end, kind."""
    return F.concat(*map(_of_kind, kinds))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(parts: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """key and weak: the weak candidates that a complementary part, not overlapping them, completes with a gap of at most scope
    code points between the two."""
    weak = [k for k in KINDS if k in COMPLETES]
    some = parts.where(F.size(F.concat(*(F.col(k) for k in weak))) > 0)
    rows = some.select(*key, F.explode(_listed(KINDS)).alias("p")).select(*key, "p.*").distinct()
    needs = F.create_map(*(x for k, v in COMPLETES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    roles = F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv))
    open_ = rows.where(F.col("kind").isin(weak)).withColumn("role", F.explode(needs[F.col("kind")]))
    # In every cell that a part, or a candidate with the scope around it, has code points of.
    from_, to = F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope)
    open_ = open_.withColumn("cell", F.explode(F.sequence(from_, to))).alias("a")
    with_role = rows.select(*key, F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))).alias("cell"), "start", "end", roles[F.col("kind")].alias("role")).alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key] + [F.col("a.cell") == F.col("b.cell"), F.col("a.role") == F.col("b.role")]
    apart = (F.col("b.start") >= F.col("a.end")) | (F.col("b.end") <= F.col("a.start"))
    near = F.greatest("a.start", "b.start") - F.least("a.end", "b.end") <= scope
    on += [near, apart]
    done = open_.join(with_role, on, "left_semi").select(*key, "start", "rank", "end", "kind").distinct()
    return done.groupBy(*key).agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("weak"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: the id, n_assign, n_access, n_hex, base (the strong spans) and spans (all of them).

    Null texts are empty; a repeated row is scanned as often as it occurs; an empty table gives no rows. Whole texts
    are scanned, however long.
    """
    key = ["id", "text_hash"]
    keep = [F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash")]
    parts = staged(parts_of(docs, text_col, keep), "parts")
    found = linked(parts, key, scope).withColumnsRenamed({k: f"w_{k}" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in key]
    base = _listed(["assign", "access", "hex"])
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING>>)")
    return parts.join(found, on, "left").select(
        F.col("id").alias(id_col), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"), F.concat(base, F.coalesce("weak", none)).alias("spans")
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


ORACLE: dict[str, str] = {}
