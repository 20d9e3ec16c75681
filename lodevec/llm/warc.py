"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

Archives are .warc.gz files with one gzip member a record (or plain .warc). Both sides go through pyarrow's file
systems, so the folder may be on any store that those open.

The reader checks each record: the member's own checksum, the version line, the declared length, the end mark, and block
and payload digests of the algorithms it knows. After a failed check it searches on, byte by byte from the failure, for
the next member or version line at which all checks pass, also inside what a member holds, goes on from there, and logs
the bytes between as a quarantined gap. Of a member whose checksum fails nothing is taken, as any of its bytes may be
wrong; of one that the file's end cuts, the whole records that another one follows and whose digest fits. Nothing that a
file holds raises an error. A member is held whole, inflated; so is a record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevec.llm.common import scratch, staged, table, text_or_empty

# Fixed values of the format.
VERSION, END, MAGIC = b"WARC/1.1", b"\r\n\r\n", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:lodevec:page:"
DATE = "2000-01-01T00:00:00Z"
#: What a record and a member begin with, as far as the search goes.
LINE = b"WARC/1."
#: Digests that can be checked, by name, with their length in bytes.
ALGORITHMS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
#: Bytes of an archive after which the next begins, of a window read at once.
ARCHIVE, WINDOW = 256 << 20, 1 << 20
#: A payload with more than this share of the rows is joined by broadcast; there are fewer than 1 / HEAVY.
HEAVY = 1 / 1000


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit without the payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + END + block + END


@dataclass
class Record:
    type: str
    page_id: int | None
    url: str | None
    refers_to: int | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str


@dataclass
class Gap:
    begin: int
    end: int
    reason: str


class Damaged(Exception):
    pass


def _number(text: str | bytes | None) -> int | None:
    """A decimal number of at most 18 digits, so that it fits into 64 bits."""
    text = text.decode("latin-1") if isinstance(text, bytes) else text or ""
    return int(text) if re.fullmatch("-?[0-9]{1,18}", text) else None


def _page(value: str | None) -> int | None:
    """The page of a record id that this module wrote; null for any other id."""
    m = re.fullmatch(rf"<{URN}(-?[0-9]{{1,19}})>", value or "")
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def _header(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with a blank goes on with the one before."""
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Damaged("no version line")
    out, key = {}, None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and key is not None:
            out[key] = f"{out[key]} {line.decode('utf-8', 'replace').strip()}"
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        key = name.decode("utf-8", "replace").strip().lower()
        if key in out and key != "warc-concurrent-to":
            raise Damaged("a repeated field")
        out[key] = value.decode("utf-8", "replace").strip()
    if (_number(out.get("content-length")) or 0) < 0 or _number(out.get("content-length")) is None:
        raise Damaged("no length")
    return out


def _fits(said: str | None, data: bytes) -> bool | None:
    """Whether data has the digest; null if none is given, or none of a known algorithm in base32 or hexadecimal."""
    name, _, value = (said or "").partition(":")
    size = ALGORITHMS.get(name.lower())
    if size is None:
        return None
    own = hashlib.new(name.lower(), data).digest()
    if len(value) == 2 * size:
        return value.lower() == own.hex()
    if len(value.rstrip("=")) == -(-8 * size // 5):
        return value.rstrip("=").upper() == base64.b32encode(own).decode().rstrip("=")
    return None


def _checked(h: dict[str, str], block: bytes) -> Record | None:
    """The record of a header and its block, if their digests fit; None for types other than response and revisit."""
    if _fits(h.get("warc-block-digest"), block) is False:
        raise Damaged("block digest")
    kind = h.get("warc-type", "")
    if kind not in ("response", "revisit"):
        return None
    head, mark, payload = block.partition(END)
    if not mark:
        raise Damaged("no end of the HTTP header")
    url = unquote(h["warc-target-uri"]) if "warc-target-uri" in h else None
    said = h.get("warc-payload-digest", "")
    if kind == "response":
        if _fits(said, payload) is False:
            raise Damaged("payload digest")
        return Record(kind, _page(h.get("warc-record-id")), url, None, payload, len(payload), digest32(payload))
    m = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*$", head.replace(b"\r\n", b"\n"))
    return Record(kind, _page(h.get("warc-record-id")), url, _page(h.get("warc-refers-to")), None, int(m[1]) if m else 0, said.removeprefix("sha1:"))


class Source:
    """Bytes of a seekable file, by position, through one window that is kept."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.begin, self.held = 0, b""
        self.found: dict[bytes, tuple[int, int]] = {}

    def __call__(self, pos: int, n: int) -> bytes:
        """Up to n bytes from pos; fewer only where the file ends."""
        n = min(n, max(0, self.size - pos))
        if not self.begin <= pos <= pos + n <= self.begin + len(self.held):
            self.file.seek(pos)
            self.begin, self.held = pos, self.file.read(min(max(n, WINDOW), self.size - pos))
        return self.held[pos - self.begin : pos - self.begin + n]

    def find(self, mark: bytes, pos: int) -> int:
        """Where mark next begins at or after pos; the size if nowhere. The last answer is kept, so that many searches that
        end in the same place read the bytes before it once."""
        first, at = self.found.get(mark, (1, 0))
        if not first <= pos <= at:
            first = at = pos
            while at < self.size:
                some = self(at, WINDOW)
                if (k := some.find(mark)) >= 0:
                    at += k
                    break
                at += max(1, len(some) - len(mark) + 1)
            self.found[mark] = first, min(at, self.size)
        return self.found[mark][1]


@dataclass
class Salvage:
    """Reads one archive; iterate over records(), then gaps holds what was quarantined."""

    file: object  # a pyarrow NativeFile, or any seekable binary file
    size: int
    gaps: list[Gap] = field(default_factory=list)

    def _member(self, source: Source, pos: int) -> tuple[bytes, int, bool]:
        """What the gzip member at pos holds, where it ends, and whether it is whole; cut only by the file's end."""
        inflate, out, at = zlib.decompressobj(31), [], pos
        while not inflate.eof:
            some = source(at, WINDOW)
            if not some:
                return b"".join(out), at, False
            try:
                out.append(inflate.decompress(some))
            except zlib.error as e:
                raise Damaged(f"member: {e}") from None
            at += len(some)
        return b"".join(out), at - len(inflate.unused_data), True

    def _record(self, source: Source, pos: int) -> tuple[Record | None, int, bool | None]:
        """The record whose version line is at pos, where it ends, and whether it has a block digest that fits."""
        if not re.fullmatch(rb"WARC/1\.[01]\r\n", source(pos, len(VERSION) + 2)):
            raise Damaged("no version line")
        cut = source.find(END, pos)
        if cut >= source.size or source.find(b"\r\n" + LINE, pos) < cut:
            raise Damaged("no end of the header")
        h = _header(source(pos, cut - pos))
        n, begin = _number(h["content-length"]), cut + len(END)
        if begin + n + len(END) > source.size or source(begin + n, len(END)) != END:
            raise Damaged("length")
        block = source(begin, n)
        return _checked(h, block), begin + n + len(END), _fits(h.get("warc-block-digest"), block)

    def _inside(self, data: bytes, whole: bool) -> tuple[list[Record], list[str]]:
        """The records of what a member holds, and what was wrong between them."""
        source, pos, found, wrong, lost, reason = Source(io.BytesIO(data), len(data)), 0, [], [], None, ""
        if not data and not whole:
            wrong.append("a cut member")
        while pos < len(data):
            try:
                r, end, sure = self._record(source, pos)
                if not whole and not (sure and data.startswith(LINE, end)):
                    raise Damaged("a cut member")
            except Damaged as e:
                if lost is None:
                    lost, reason = pos, str(e)
                pos = source.find(LINE, pos + 1)
                continue
            if lost is not None:
                wrong.append(f"{reason}, bytes {lost} to {pos} of the member")
                lost = None
            if r is not None:
                found.append(r)
            pos = end
        if lost is not None:
            wrong.append(f"{reason}, bytes {lost} to {pos} of the member")
        return found, wrong

    def records(self) -> Iterator[Record]:
        """Each record that passes all checks, in order."""
        source = Source(self.file, self.size)
        zipped = source(0, 2) == MAGIC[:2] or (source(0, 5) != LINE[:5] and source.find(MAGIC, 0) < source.find(LINE, 0))
        pos, lost, reason = 0, None, ""
        while pos < self.size:
            try:
                if source(pos, len(MAGIC)) == MAGIC and zipped:
                    data, end, whole = self._member(source, pos)
                    found, wrong = self._inside(data, whole)
                    if not found and wrong:
                        raise Damaged(wrong[0])
                else:
                    record, end, _ = self._record(source, pos)
                    found, wrong = [record] * (record is not None), []
            except Damaged as e:
                if lost is None:
                    lost, reason = pos, str(e)
                line = source.find(LINE, pos + 1)
                pos = min(source.find(MAGIC, pos + 1), line) if zipped else line
                continue
            if lost is not None:
                self.gaps.append(Gap(lost, pos, reason))
                lost = None
            self.gaps += [Gap(pos, end, w) for w in wrong]
            yield from found
            pos = end
        if lost is not None:
            self.gaps.append(Gap(lost, self.size, reason))


def write_archives(pages: DataFrame, folder: str, least: int = 0, zipped: bool = True, archive: int = ARCHIVE) -> DataFrame:
    """page_id, url, html -> the archives' path and records (a small table, staged).

    Of rows with equal payloads of at least `least` bytes those with the largest page_id (null is the smallest) are
    responses and the others revisit it; smaller payloads are all responses. Null html is an empty payload; rows that
    repeat the largest page_id are all responses; rows without any page_id in their group are all responses. A task that
    runs again writes new files, and only those of the attempt that counts are listed.
    """
    html = text_or_empty("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    sized = rows.where(F.octet_length("html") >= least)
    groups = staged(sized.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("many")).where("many > 1"), "payloads")
    floor = rows.count() * HEAVY
    heavy = F.broadcast(groups.where(F.col("many") > floor).select("digest", F.col("top").alias("hot")))
    spread = rows.join(heavy, "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string")))
    light = groups.where(F.col("many") <= floor).select(F.col("digest").alias("key"), "top")
    told = spread.join(light.hint("merge"), "key", "left").select("page_id", "url", "html", F.coalesce("hot", "top").alias("top"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        out, path, done, held = None, "", [], 0
        for batch in batches:
            for page, url, text, top in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    path = f"{root}/{name}-{len(done):04d}.warc" + ".gz" * zipped
                    out, held = store.open_output_stream(path, compression=None), 0
                revisit = top is not None and page != top
                data = record(page, url, text.encode(), top if revisit else None, revisit)
                if zipped:
                    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = deflate.compress(data) + deflate.flush()
                out.write(data)
                held += 1
                if out.tell() >= archive:
                    out.close()
                    done.append((path, held))
                    out = None
        if out is not None:
            out.close()
            done.append((path, held))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": pa.array([n for _, n in done], pa.int64())})

    return staged(told.mapInArrow(write, "path string, records long"), "archives")


SCHEMA = "path string, page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, gap_begin long, gap_end long, gap_reason string"


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives in column path, and one for each gap (record_type null)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_file(path) as f:
                    salvage, rows, held = Salvage(f, f.size()), [], 0
                    for r in salvage.records():
                        kept = r.payload if payloads else None
                        rows.append((path, r.page_id, r.url, r.type, r.refers_to, kept, r.payload_bytes, r.payload_digest, None, None, None))
                        held += len(kept or b"")
                        if len(rows) >= 5000 or held > 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                    rows += [(path, *[None] * 7, g.begin, g.end, g.reason) for g in salvage.gaps]
                    if rows:
                        yield made(rows)

    files = archives.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, SCHEMA)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null urls have no target. Every record written is to come back: a lost one, or a gap, is an error."""
    folder = scratch(spark, "warc")
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    back = staged(read_archives(archives, folder, payloads=False).drop("payload", "url"), "records")
    written = archives.agg(F.sum("records")).first()[0] or 0
    read, gaps = back.agg(F.count("record_type"), F.count("gap_begin")).first()
    if (read, gaps) != (written, 0):
        raise RuntimeError(f"{read} of {written} records were read back, with {gaps} gaps")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = {
    "op6_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
        b AS (SELECT page_id, payload_bytes, hex, CAST(CAST(unhex(hex) AS BIT) AS VARCHAR) AS bits, max(page_id) OVER (PARTITION BY hex) AS top FROM h)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                   16 * CAST(substr(bits, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS BIGINT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS BIGINT)
                   + 2 * CAST(substr(bits, 5 * i + 4, 1) AS BIGINT) + CAST(substr(bits, 5 * i + 5, 1) AS BIGINT) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM b"""
}
