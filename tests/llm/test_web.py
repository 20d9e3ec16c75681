import base64
import collections
import hashlib
import io
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from lodevec.llm import queries, url_filters, warc
from lodevec.llm.common import scratch

PAGES = "page_id long, url string, html string"


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, None, None), (2, "http://a.example.org/x", ""), (3, "no scheme", "<p>same"), (4, "https://B.Example.com/fr/é\r\n?q#f", "<p>same"), (5, "://", "x" * 300_000), (None, "http://c.org", "<p>same"), (4, "https://B.Example.com/fr/", "<p>same"), (6, "ftp://c.org?x", " 😀\r\n\r\nWARC/1.1\r\n")]
    return spark.createDataFrame(rows, PAGES), rows


def test_warc_equals_sql(spark, sf_dir):
    got = queries.QUERIES["op6_warc"](spark, sf_dir).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = c.sql(queries.ORACLE["op6_warc"]).df()
    cols = sorted(want.columns)
    a, b = (x[cols].sort_values("page_id").astype(object).where(x[cols].sort_values("page_id").notna(), None).values.tolist() for x in (got, want))
    assert a == b


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("least", [0, 100])
def test_warc_odd(spark, odd_pages, zipped, least):
    df, rows = odd_pages
    folder = scratch(spark, "warc")
    got = warc.read_archives(warc.write_archives(df, folder, least, zipped, archive=1 << 16), folder).collect()
    assert all(r["record_type"] for r in got)
    top = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= least:
            top[digest(h)] = max([x for x in (top.get(digest(h)), i) if x is not None], default=None)
    want = sorted(((i, len((h or "").encode()), digest(h), "revisit" if (t := top.get(digest(h))) is not None and i != t else "response", t if (t := top.get(digest(h))) is not None and i != t else None) for i, _, h in rows), key=str)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want
    assert {r["url"] for r in got} == {u for _, u, _ in rows}
    assert all(bytes(r["payload"]).decode() in {h or "" for _, _, h in rows} for r in got if r["record_type"] == "response")


def test_warc_empty(spark, odd_pages):
    folder = scratch(spark, "warc")
    assert warc.read_archives(warc.write_archives(odd_pages[0].limit(0), folder), folder).count() == 0


def archive(n, zipped, seed=0):
    r = random.Random(seed)
    parts = []
    for i in range(n):
        data = warc.record(i, f"http://h/{i}", r.randbytes(r.randint(0, 400)), None, False)
        if zipped:
            d = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = d.compress(data) + d.flush()
        parts.append(data)
    return parts


def read(data):
    s = warc.Salvage(io.BytesIO(data), len(data))
    return [r.page_id for r in s.records()], s.gaps


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = archive(30, zipped)
    edges = np.cumsum([0, *map(len, parts)])
    whole = b"".join(parts)
    assert read(whole) == (list(range(30)), [])
    # One record's bytes are overwritten, one is cut, junk stands between two, and the file ends early.
    hurt = bytearray(whole)
    hurt[edges[5] - 6] ^= 0xFF
    ids, gaps = read(bytes(hurt))
    assert ids == [i for i in range(30) if i != 4] and [(g.begin, g.end) for g in gaps] == [(edges[4], edges[5])]
    cut = whole[: edges[7] + 20] + whole[edges[8] :]
    ids, gaps = read(cut)
    assert ids == [i for i in range(30) if i != 7] and [(g.begin, g.end) for g in gaps] == [(edges[7], edges[7] + 20)]
    junk = whole[: edges[3]] + b"junk \x1f\x8b\x08 WARC/1.1\r\n" + whole[edges[3] :]
    ids, gaps = read(junk)
    assert ids == list(range(30)) and gaps[0].begin == edges[3] and gaps[0].end == edges[3] + 19
    ids, gaps = read(whole[:-3])
    assert ids == list(range(29)) and [(g.begin, g.end) for g in gaps] == [(edges[29], len(whole) - 3)]
    ids, gaps = read(whole[5:])
    assert ids == list(range(1, 30)) and gaps[0].begin == 0


def test_salvage_of_junk():
    for data in (b"", b"junk", b"\x1f\x8b\x08", b"WARC/1.1\r\n\r\n"):
        ids, gaps = read(data)
        assert ids == [] and [(g.begin, g.end) for g in gaps] == ([(0, len(data))] if data else [])


def gzipped(data):
    d = zlib.compressobj(6, zlib.DEFLATED, 31)
    return d.compress(data) + d.flush()


def test_salvage_goes_on_inside_a_member():
    """Three records in one member, the middle one damaged before it was compressed; then a member that the end cuts."""
    parts = archive(8, False)
    hurt = bytearray(parts[1])
    hurt[-6] ^= 0xFF
    first = gzipped(parts[0] + bytes(hurt) + parts[2])
    ids, gaps = read(first + gzipped(parts[3]))
    assert ids == [0, 2, 3] and [(g.begin, g.end) for g in gaps] == [(0, len(first))] and "block digest" in gaps[0].reason
    noise = random.Random(1).randbytes(5000)
    last = gzipped(b"".join(parts[4:7]) + warc.record(7, None, noise, None, False))
    ids, gaps = read(gzipped(parts[3]) + last[:-2000])
    assert ids == [3, 4, 5] or ids == [3, 4, 5, 6]
    assert gaps[-1].end == len(gzipped(parts[3])) + len(last) - 2000


def test_plain_and_zipped_records_in_one_file():
    parts = archive(4, False)
    ids, gaps = read(gzipped(parts[0]) + b"junk" + parts[1] + gzipped(parts[2]) + parts[3])
    assert ids == [0, 1, 2, 3] and [(g.begin, g.end) for g in gaps] == [(len(gzipped(parts[0])), len(gzipped(parts[0])) + 4)]


@pytest.mark.parametrize("length", ["²", "9" * 5000, "-1", "", "1" * 18, "0x10", "+5"])
def test_odd_lengths_are_damage(length):
    parts = archive(3, False)
    odd = re.sub(rb"(?<=\r\nContent-Length: )\d+(?=\r\n\r\nHTTP)", lambda _: length.encode(), parts[1])
    assert read(parts[0] + odd + parts[2])[0] == [0, 2]
    assert read(gzipped(parts[0] + odd + parts[2]))[0] == [0, 2]


def test_odd_headers(spark, tmp_path):
    """Ids beyond 64 bits, other digests, folded lines and very long urls are no damage."""
    far = warc.record(10**25, "http://far", b"x", None, False)
    long = warc.record(1, "http://h/" + "u" * 2_000_000, b"y", None, False)
    sha256 = re.sub(rb"WARC-Payload-Digest: \S+", b"WARC-Payload-Digest: sha256:" + hashlib.sha256(b"z").hexdigest().encode(), warc.record(2, None, b"z", None, False))
    wrong = sha256.replace(b"sha256:" + hashlib.sha256(b"z").hexdigest()[:4].encode(), b"sha256:0000")
    unknown = re.sub(rb"WARC-Payload-Digest: \S+", b"WARC-Payload-Digest: xyz:1", warc.record(3, None, b"z", None, False))
    folded = warc.record(4, "http://f", b"z", None, False).replace(b"WARC-Date: ", b"X-Note: a\r\n  b\r\nWARC-Date: ")
    (tmp_path / "a.warc").write_bytes(far + long + sha256 + unknown + folded)
    archives = spark.createDataFrame([(str(tmp_path / "a.warc"),)], "path string")
    got = warc.read_archives(archives, f"file://{tmp_path}").collect()
    assert [(r["page_id"], r["record_type"]) for r in got] == [(None, "response"), *((i, "response") for i in (1, 2, 3, 4))]
    assert len(got[1]["url"]) == 2_000_009
    assert read(far + wrong + long)[0] == [None, 1]


@pytest.mark.parametrize("kind", ["plain", "zipped", "one member"])
def test_salvage_of_any_damage(kind):
    """Whatever bytes are changed, cut out or put in: no error, untouched records and members come back, no payload comes
    back changed, and what is lost shows as a gap."""
    r = random.Random(5)
    parts = archive(12, kind == "zipped", 3)
    if kind == "one member":
        parts = [gzipped(b"".join(archive(12, False, 3)[k : k + 3])) for k in range(0, 12, 3)]
    known = {x.page_id: x for x in warc.Salvage(io.BytesIO(b"".join(parts)), sum(map(len, parts))).records()}
    each = len(known) // len(parts)
    for _ in range(300):
        hurt, some = set(), list(parts)
        for k in r.sample(range(len(parts)), r.randint(1, 4)):
            data, at = bytearray(some[k]), r.randrange(len(some[k]))
            how = r.randrange(4)
            if how == 0:
                data[at] ^= 1 << r.randrange(8)
            elif how == 1:
                del data[at : at + r.randint(1, 40)]
            elif how == 2:
                data[at:at] = r.choice([b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"\r\n\r\n", r.randbytes(20)])
            else:
                data[at : at + 8] = r.randbytes(8)
            some[k], hurt = bytes(data), hurt | {k}
        whole = b"".join(some)
        salvage = warc.Salvage(io.BytesIO(whole), len(whole))
        got = {(x.page_id, x.payload) for x in salvage.records()}
        assert {(i, x.payload) for i, x in known.items() if i // each not in hurt} <= got
        assert {payload for _, payload in got} <= {x.payload for x in known.values()}
        assert all(0 <= g.begin < g.end <= len(whole) for g in salvage.gaps)
        assert salvage.gaps or len(got) == len(known) or kind == "plain"  # nothing there guards a header's letters


def test_junk_takes_linear_time():
    """Very many version lines and members' beginnings, none of which lead anywhere."""
    parts = archive(2, False)
    for junk in (b"WARC/1.1 " * 150_000, b"WARC/1.1\r\n" * 100_000, b"WARC/1.1\r\nA: b\r\n" * 80_000, b"\x1f\x8b\x08" * 100_000 + b"WARC/1.1 " * 50_000):
        t = time.perf_counter()
        ids, gaps = read(parts[0] + junk + b"\r\n\r\n" + parts[1])
        assert ids == [0, 1] and len(gaps) == 1 and time.perf_counter() - t < 30


def parsed(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def by_rule(host, path):
    fits = [(h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def check_urls(rows, urls):
    assert sorted(map(str, (r["page_id"] for r in rows))) == sorted(str(i) for i, _ in urls)
    want = sorted([(i, *parsed(u), by_rule(*parsed(u))[0]) for i, u in urls], key=str)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in rows), key=str) == want
    for r in rows:
        verdict = by_rule(r["host"], r["path"])[1]
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_urls(spark, sf_dir):
    urls = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    check_urls(queries.QUERIES["op8_link_propagation"](spark, sf_dir).collect(), urls)


def verdicts_by_hand(pages):
    """pages: (page_id, url, html). Rules, then PageRank from seeds by plain iteration, in dictionaries."""
    at = {}
    for i, url, html in pages:
        host, path = parsed(url)
        at.setdefault(host, []).append((i, path, by_rule(host, path)[1], html or ""))
    links = collections.Counter()
    for host, rows in at.items():
        for *_, html in rows:
            for dst in re.findall(url_filters.LINK, html, re.ASCII):
                links[host, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in dst)] += 1
        above = host.split(".", 1)[1] if host.count(".") >= 2 and not host.startswith(".") and not host.endswith(".") else ""
        if above:
            links[host, above] += 1
            links[above, host] += 1
    links = {(a, b): n for (a, b), n in links.items() if a and b and a != b}
    ranks = {}
    for kind, verdict, edges in (("trust", "allow", links), ("distrust", "block", {(b, a): n for (a, b), n in links.items()})):
        seeds = {h: sum(v == verdict for _, _, v, _ in rows) / len(rows) for h, rows in at.items() if h}
        seeds = {h: x for h, x in seeds.items() if x}
        out = collections.Counter()
        for (a, _), n in edges.items():
            out[a] += n
        rank = grown = {h: 0.15 * x / sum(seeds.values()) for h, x in seeds.items()}
        for _ in range(400):
            new = collections.defaultdict(float)
            for (a, b), n in edges.items():
                if a in grown:
                    new[b] += 0.85 * grown[a] * n / out[a]
            grown = new
            rank = {h: rank.get(h, 0) + new.get(h, 0) for h in rank.keys() | new.keys()}
        ranks[kind] = rank
    bad = {h for h in at if h and ranks["distrust"].get(h, 0) > ranks["trust"].get(h, 0)}
    return sorted((str(i), verdict or ("block" if host in bad else "allow")) for host, rows in at.items() for i, _, verdict, _ in rows)


def test_verdicts_against_brute_force(spark, sf_dir):
    base = sf_dir.rsplit("/", 1)[0] + "/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{base}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.QUERIES["op8_link_propagation"](spark, base).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in got) == verdicts_by_hand(pages)


def test_verdicts_of_made_up_links(spark):
    """Hosts that link to blocked ones, one of them with half of all pages, null urls, hosts that nothing reaches."""
    r = random.Random(8)
    hosts = ["example.org", "a.example.org", "x.com", "m.x.com", "far.net", "bad.net", "WWW.Bad.net", "hub.io"]
    rows = []
    for i in range(400):
        host = "hub.io" if i % 2 else r.choice(hosts)
        html = " ".join(f'<a href="{r.choice(["http://", "https://", "//"])}{r.choice(hosts)}/p">' for _ in range(r.randint(0, 3)))
        rows.append((i, None if i % 37 == 0 else f"http://{host}{r.choice(['/es/', '/en/1', '/fr/', '/de/', '/', ''])}{i}?q", html))
    got = url_filters.judged(spark.createDataFrame(rows, PAGES), url_filters.RULES).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in got) == verdicts_by_hand(rows)
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_urls_odd(spark, odd_pages):
    df, rows = odd_pages
    check_urls(url_filters.judged(df, url_filters.RULES).collect(), [(i, u) for i, u, _ in rows])
    assert url_filters.judged(df.limit(0), url_filters.RULES).count() == 0


def test_propagation_equals_brute_force(spark):
    r = random.Random(1)
    hosts = [f"h{i}.net" for i in range(12)]
    links = {(a, b): r.randint(1, 4) for a in hosts for b in hosts if a != b and r.random() < 0.25}
    seeds = [("trust", "h0.net", 1.0), ("trust", "h1.net", 0.5), ("distrust", "h5.net", 1.0)]
    got = {(x["kind"], x["host"]): x["rank"] for x in url_filters.propagate(spark.createDataFrame([(a, b, float(n)) for (a, b), n in links.items()], "src string, dst string, n double"), spark.createDataFrame(seeds, "kind string, host string, seed double")).collect()}
    for kind in ("trust", "distrust"):
        m = np.zeros((12, 12))
        for (a, b), n in links.items():
            i, j = hosts.index(a), hosts.index(b)
            m[(i, j) if kind == "trust" else (j, i)] += n
        m /= np.maximum(m.sum(axis=1, keepdims=True), 1e-12)
        s = np.array([sum(v for k, h, v in seeds if k == kind and h == x) for x in hosts])
        s /= s.sum()
        x = s.copy()
        for _ in range(url_filters.STEPS):
            x = url_filters.DAMPING * (x @ m) + (1 - url_filters.DAMPING) * s
        assert np.allclose([got.get((kind, h), 0.0) for h in hosts], x)


def test_links_spread_a_block(spark):
    rows = [(1, "http://bad.example.org/es/1", ""), (2, "http://friend.net/", '<a href="http://bad.example.org/">'), (3, "http://good.example.org/x", '<a href="//liked.net/a">'), (4, "http://liked.net/", ""), (5, "http://alone.net/", "")]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judged(spark.createDataFrame(rows, PAGES), url_filters.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_a_block_goes_down_a_chain(spark):
    """Every host of a long chain that links towards a blocked one is blocked, however far off."""
    rows = [(0, "http://h0.example.org/es/1", "")] + [(i, f"http://h{i}.net/", f'<a href="http://h{i - 1}{".net" if i > 1 else ".example.org"}/">') for i in range(1, 31)]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judged(spark.createDataFrame(rows, PAGES), url_filters.RULES).collect()}
    assert got == dict.fromkeys(range(31), "block")


def test_large_graphs_get_the_same_ranks(spark, monkeypatch):
    r = random.Random(2)
    links = spark.createDataFrame([(f"h{a}", f"h{b}", float(r.randint(1, 4))) for a in range(12) for b in range(12) if a != b and r.random() < 0.25] + [(f"c{i}", f"c{i + 1}", 1.0) for i in range(20)] + [("h0", "c0", 1.0)], "src string, dst string, n double")
    seeds = spark.createDataFrame([("trust", "h0", 1.0), ("distrust", "h5", 1.0)], "kind string, host string, seed double")
    small = {(x["kind"], x["host"]): x["rank"] for x in url_filters.propagate(links, seeds).collect()}
    monkeypatch.setattr(url_filters, "SMALL", 0)
    large = {(x["kind"], x["host"]): x["rank"] for x in url_filters.propagate(links, seeds).collect()}
    assert ("trust", "c20") in small and small.keys() == large.keys() and all(abs(small[k] - large[k]) <= 1e-7 * small[k] for k in small)
