"""Every query with SQL against DuckDB on the smallest data, and the others against plain Python."""

import difflib
import glob
import hashlib
import html
import json
import math
import os
import random
import re
from datetime import datetime, timedelta
from xml.dom import minidom

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chains, diffs, health, history, registry
from tidemark.plans import ledger, problems, reference
from tidemark.plans.ordered import previous_row, running_max
from tidemark.sources import files, sinks
from tidemark.sources.pages import PageFetcher, fetch_all
from tidemark.streaming.streaks import append_new

ORACLES = {**problems.ORACLES, **reference.ORACLES, **ledger.ORACLES}
QUERIES = {**problems.QUERIES, **reference.QUERIES, **ledger.QUERIES}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    rows = lambda data, get: sorted((tuple(cell(get(r, c)) for c in sorted(names)) for r in data), key=repr)
    assert rows(df.collect(), lambda r, c: r[c]) == rows(cur.fetchall(), lambda r, c: r[names.index(c)])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


SPACES = "\t\x0b\x0c \x1c\x1f\x85\xa0 　"


def plain_normalized(t):
    t = t.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"[^\S\n]+", " ", t)
    return "\n".join(x.strip() for x in t.split("\n") if x.strip()).lower()


def test_normalized_text(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("aB\n\r" + SPACES + "é<") for _ in range(r.randrange(40))) for _ in range(300)] + ["", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalized_text(F.col("t")).alias("n")).collect()
    for x in got:
        assert x.n == (None if texts[x.i] is None else plain_normalized(texts[x.i]))


def test_pages(spark):
    from tidemark.operators.pages import normalized_pages, with_title

    pages = [
        b"<html><head><title>A &amp; B</title><script>x<y</script ></head><body><!-- c --><p>One&nbsp;two<br>three</p><style>p{}</style></body></html>",
        b"<p>\xff\xfe caf\xc3\xa9 &eacute; &#x41; &amp;lt;</p>", b"", None, b"<div>same</div>\r\n<DIV class='x'>  same </DIV>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, raw_bytes binary")
    got = {x.i: x for x in normalized_pages(df).collect()}
    assert got[0].page_text == "a & b\none two\nthree"
    assert got[1].page_text == "�� café é a &lt;"
    assert got[2].page_text == "" and got[2].normalized_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].page_text is None
    assert got[4].page_text == "same\nsame"
    titles = {x.i: x.t for x in with_title(df, "raw_bytes", "t").collect()}
    assert titles[0] == "A & B" and titles[1] == ""
    loose = [b"<title lang='x'>F&eacute;es \n &lt;b&gt; <i>2</i></title foo><script>var a=1;</script foo=\"x\"><style>p{}</style\n><legend>One</legend><option>two</option>three<script>b</script >"]
    row = with_title(normalized_pages(spark.createDataFrame([(loose[0],)], "raw_bytes binary")), "raw_bytes", "t").first()
    assert row.t == "F\u00e9es <b> 2" and row.page_text == "f\u00e9es\n<b> 2\none\ntwo three", row
    assert html.unescape("&eacute;") == "é"


def test_excerpt(spark):
    r = random.Random(2)
    texts = ["\n".join("x" * r.randrange(1, 200) for _ in range(r.randrange(20))) for _ in range(50)]

    def plain(t):
        left, out = 900, []
        for p in [x for x in t.split("\n") if x][:12]:
            if left <= 0:
                break
            out.append(p[:left])
            left -= len(p)
        return "\n".join(out)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.excerpt(F.col("t")).alias("e")).collect()
    assert all(x.e == plain(texts[x.i]) for x in got)


def test_small_functions(spark):
    row = spark.range(1).select(
        T.duration_words(F.lit(200_000)).alias("a"), T.duration_words(F.lit(90_000)).alias("b"), T.duration_words(F.lit(7_300)).alias("c"), T.duration_words(F.lit(121)).alias("d"), T.duration_words(F.lit(5)).alias("e"),
        T.strict_date(F.lit("2026-1-1")).alias("f"), T.strict_date(F.lit("2026-02-30")).alias("g"), T.strict_date(F.lit("2026-02-03")).alias("h"), T.rfc2822(F.lit("2026-01-05 07:11:00").cast("timestamp")).alias("i"),
        T.xml_escaped(F.lit("<a&'\">")).alias("j"), T.netloc(F.lit("HTTPS://U@Ex.org:8/x")).alias("k"), T.host(F.lit("HTTPS://U@Ex.org:8/x")).alias("l"), T.url_faults(F.lit("http://u@h/#f")).alias("m"),
        T.change_id(F.lit("s"), F.lit("p"), F.lit(None).cast("string")).alias("n")).first()
    assert [row[c] for c in "abcde"] == ["2 days", "1 day", "2 hours", "2 minutes", "5 seconds"]
    assert row.f is None and row.g is None and str(row.h) == "2026-02-03"
    assert row.i == "Mon, 05 Jan 2026 07:11:00 +0000" and row.j == "&lt;a&amp;&apos;&quot;&gt;"
    assert row.k == "u@ex.org:8" and row.l == "ex.org" and row.m == ["not-https", "credentials", "fragment"]
    assert row.n == hashlib.sha256(b"s\np\n").hexdigest()[:16]


def test_actor_identity(spark):
    names = ["Ａda  Ｌ.", "Straße", "a​b", " ", "é" * 101, None]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", T.actor_identity(F.col("n")).alias("x")).orderBy("i").collect()
    assert [x.x for x in got] == ["ada l.", "strasse", "", "", "", None]


def _attempts(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        rows.append((r.choice(["hot", "hot", "a", "b", "c"]), datetime(2026, 1, 5) + timedelta(hours=r.randrange(900)), f"r{i:04d}", r.choice(["measured", "no-text", "not-retrieved", "not-retrieved"])))
    return rows, spark.createDataFrame(rows, "source_id string, at timestamp_ntz, seq string, outcome string")


@pytest.mark.parametrize("seed", range(3))
def test_streaks_against_fold(spark, seed):
    rows, df = _attempts(spark, seed)
    want, state = {}, {}
    for s, at, seq, outcome in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        n, start, had = state.get(s, (0, None, False))
        if outcome == "no-text":
            continue
        if outcome == "measured":
            n, start, had = 0, None, True
        else:
            n, start = n + 1, start if n else at
        state[s] = (n, start, had)
        want[seq] = (n, start if n else None, had)
    out = health.streaks(df)
    got = {x.seq: (x.streak, x.streak_started_at if x.streak else None, x.had_success) for x in out.collect()}
    assert got == want
    hits = {x.seq for x in health.escalations(out, 3, 1).collect()}
    times = {x[2]: x[1] for x in rows}
    outcome = {x[2]: x[3] for x in rows}
    assert hits == {q for q, (n, start, had) in want.items() if n >= 3 and had and outcome[q] == "not-retrieved" and times[q] - start >= timedelta(days=1)}


def test_ordered_plans(spark):
    r = random.Random(9)
    rows = [(r.choice(["h", "h", "a", None]), r.choice([None, *range(30)]), i, r.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v int")
    key = lambda x: (x[1] is not None, x[1] or 0, x[2])
    lag, top = {}, {}
    for k in {x[0] for x in rows}:
        last, best = None, None
        for x in sorted((y for y in rows if y[0] == k), key=key):
            lag[x[2]] = last
            last = x[2]
            best = x[3] if best is None else max(best, x[3] if x[3] is not None else best)
            top[x[2]] = best
    block = F.floor(F.col("at") / 7)
    assert {x.id: x.prev.id if x.prev else None for x in previous_row(df, ["k"], ["at", "id"], block, ["id"]).collect()} == lag
    assert {x.id: x.m for x in running_max(df, ["k"], ["at", "id"], block, "v", "m").collect()} == top
    assert previous_row(df.filter("false"), ["k"], ["at", "id"], block, ["id"]).count() == 0


def test_as_of_and_retention(spark):
    r = random.Random(4)
    left = [(r.choice("ab"), r.choice([None, *range(50)]), i) for i in range(200)]
    right = [(r.choice("ab"), r.randrange(50), i) for i in range(80)]
    ls, rs = spark.createDataFrame(left, "k string, at int, id int"), spark.createDataFrame(right, "k string, since int, rid int")
    got = {x.id: x.found.rid if x.found else None for x in history.as_of(ls, rs, "k", "at", "since", ["since", "rid"], ["rid"], F.floor(F.col("__tm_at") / 9)).collect()}
    for k, at, i in left:
        before = [(s, q) for kk, s, q in right if kk == k and at is not None and s < at]
        assert got[i] == (max(before)[1] if before else None)
    kept = history.newest_n(rs, "k", ["rid"], 3, F.floor(F.col("rid") / 10)).collect()
    for k in "ab":
        assert sorted((x.rid for x in kept if x.k == k), reverse=True) == sorted((q for kk, _, q in right if kk == k), reverse=True)[:3]
    with pytest.raises(ValueError):
        history.newest_n(rs, "k", ["rid"], 1, F.lit(0))


def test_flapping_keeps_every_transition(spark):
    rows = [("s", i, h) for i, h in enumerate("ABAB")]
    t = history.transitions(spark.createDataFrame(rows, "source_id string, snapshot_id int, h string"), "source_id", ["snapshot_id"], F.lit(0), "h").collect()
    assert len(t) == 3 and len({x.change_id for x in t}) == 2


def test_watch_buckets(spark):
    rows = [("unreachable", False, "text", True, True, True, True, True), ("no_text", True, "no-text", True, True, True, True, True), ("new", True, "text", False, None, None, None, None), ("rebaselined", True, "text", True, False, True, True, True),
            ("unrenormalizable", True, "text", True, True, False, False, True), ("renormalized", True, "text", True, True, False, True, True), ("unchanged", True, "text", True, True, True, True, True), ("changed", True, "text", True, True, True, True, False), ("unreachable", None, "text", True, True, True, True, True)]
    df = spark.createDataFrame(rows, "want string, ok boolean, o string, p boolean, u boolean, c boolean, r boolean, h boolean")
    for x in df.select("want", history.watch_bucket(*[F.col(c) for c in ("ok", "o", "p", "u", "c", "r", "h")]).alias("got")).collect():
        assert x.want == x.got


def test_diffs(spark):
    rows = [(1, "a\nb\nc", "a\nx\nc"), (2, "a\n\nb", "a\nb"), (3, None, "a"), (4, "\n".join(map(str, range(3000))), "z")]
    df = spark.createDataFrame(rows, "i int, o string, n string")
    got = {x.i: x.d for x in diffs.unified_diffs(df, "o", "n", "d").collect()}
    assert got[1] == "\n".join(difflib.unified_diff(["a", "b", "c"], ["a", "x", "c"], "previous", "current", lineterm="", n=2))
    assert got[2] == "(no difference in passages: the change is in markup.)" and got[3] is None and got[4].endswith("[cut at 4000 characters]") and len(got[4]) < 4_100
    assert diffs.unified("", "", "https://x") == "(binary page: no text to compare. See https://x.)"
    assert diffs.unified("\n".join(map(str, range(3000))), "z", None, "text-v1/none-v1").startswith("(old side derived again from its bytes, recorded under text-v1/none-v1)\n\n--- previous")
    moved = {(x.i, x.passage): (x.n_removed, x.n_added) for x in diffs.passage_rows(df.filter("i = 1"), ["i"], "o", "n").collect()}
    assert moved == {(1, "b"): (1, 0), (1, "x"): (0, 1)}


def test_scopes_and_gaps(spark):
    rows = [("a", "AK", "x"), ("b", "AL", "y"), ("c", None, "x")]
    df = spark.createDataFrame(rows, "source_id string, jurisdiction string, document_class string")
    assert [r.source_id for r in registry.in_scope(df, " ak").collect()] == ["a"]
    with pytest.raises(ValueError):
        registry.in_scope(df, "zz")
    gaps = spark.createDataFrame([("AK", "y"), ("AL", "y")], "jurisdiction string, document_class string")
    got = {tuple(r) for r in registry.completeness_faults(df, df, gaps).collect()}
    assert got == {("AL", "x", "silent"), ("AL", "y", "stale")}


def test_public_text(spark):
    texts = ["fine\n\ttext", "a\u200bb", "a\x07", "x" * 16_001, "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(T.public_text_verdict(F.col("t")).alias("v"), "i").orderBy("i").collect()
    assert [r.v for r in got] == ["safe", "control", "control", "long", "empty", "empty"]


def test_lifecycle_time_is_part_of_the_guid(spark):
    cols = "change_id string, jurisdiction string, document_class string, kind string, url string, observed_at timestamp_ntz, lifecycle_at timestamp_ntz, publication_status string, superseded_by string, lifecycle_reason string, lifecycle_actor string"
    at = datetime(2026, 1, 5, 1, 2, 3)
    rows = [("c", "AK", "x", "k", "u", at, at, "withdrawn", None, "r", "a"), ("c", "AK", "x", "k", "u", at, at + timedelta(microseconds=5), "withdrawn", None, "r", "a")]
    got = [r.guid for r in sinks.feed_items(spark.createDataFrame(rows, cols)).collect()]
    want = [hashlib.sha256("\n".join(["c", "withdrawn", "", "r", "a", f"{x[6].isoformat()}+00:00"]).encode()).hexdigest()[:16] for x in rows]
    assert got == [f"c-lifecycle-{w}" for w in want]


def test_chains(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x"), ("q", None)]
    got = {x.id: (x.end_id, x.steps, x.cyclic) for x in chains.chain_ends(spark.createDataFrame(edges, "id string, next_id string")).collect()}
    assert got["a"] == ("d", 3, False) and got["c"] == ("d", 1, False)
    assert got["x"] == (None, -1, True) and got["w"] == (None, -1, True) and "q" not in got
    assert chains.chain_ends(spark.createDataFrame([], "id string, next_id string")).count() == 0


def test_registry_files(spark, tmp_path):
    entry = {"id": "a-b", "jurisdiction": "AK", "document_class": "c", "url": "https://x/y", "authority": "z", "verified": True, "verification": {"status": "verified", "verifier": "R", "at": "2026-01-01", "note": "", "evidence": "", "expires_at": ""}}
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"registry_version": "1.0", "sources": [entry], "gaps": [{"jurisdiction": "AL", "document_class": "c", "reason": "none", "hosts": ["h"], "checked": "2026-01-01", "detail": "d"}]}))
    e, g = files.read_registry(spark, str(p))
    assert e.first().active is True and g.first().hosts == ["h"]
    p2 = tmp_path / "bad.json"
    p2.write_text(json.dumps({"registry_version": "9", "sources": [entry]}))
    with pytest.raises(ValueError):
        files.read_registry(spark, str(p2))
    p3 = tmp_path / "broken.json"
    p3.write_text("{")
    with pytest.raises(Exception):  # noqa: B017
        files.read_registry(spark, str(p3))
    assert registry.revision([entry]) == registry.revision([dict(reversed(entry.items()))])


def test_baseline_round_trip(spark, tmp_path):
    latest = spark.createDataFrame([("a", "https://x", "1" * 64, "2026-01-01", "n", "e"), ("b", "u", "", "", "", "")], "source_id string, url string, sha256 string, observed_at string, normalizer_version string, extractor_version string")
    text = sinks.baseline_document(latest, ["a", "b"], "2026-01-02")
    sinks.publish({"b/baseline.json": text}, str(tmp_path / "out"))
    got = files.read_baselines(spark, str(tmp_path / "out/b/baseline.json")).collect()
    assert [(x.source_id, x.sha256) for x in got] == [("a", "1" * 64)] and json.loads(text)["unreachable"] == ["b"]
    bad = json.loads(text)
    bad["baselines"]["a"]["sha256"] = files.EMPTY_SHA256
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(Exception):  # noqa: B017
        files.read_baselines(spark, str(tmp_path / "bad.json")).collect()
    assert files.read_texts(spark, str(tmp_path / "bad.json")).count() == 1


def test_publish_is_all_or_nothing(tmp_path):
    out = tmp_path / "site"
    sinks.publish({"a.txt": "1", "d/b.txt": "2"}, str(out))
    sinks.publish({"a.txt": "3"}, str(out))
    assert sorted(p.name for p in out.rglob("*")) == ["a.txt"] and (out / "a.txt").read_text() == "3"
    with pytest.raises(ValueError):
        sinks.publish({"../x": ""}, str(out))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["site"]


def test_feeds_and_rows(spark, small, tmp_path):
    c = spark.read.parquet(f"{small}/changes.parquet")
    xml = sinks.feed_xml(sinks.feed_items(c), "Changes & more")
    assert len(minidom.parseString(xml).getElementsByTagName("item")) > 0
    assert "nothing published" in sinks.feed_xml(sinks.feed_items(c.filter("false")), "x")
    rows = c.select("change_id", "jurisdiction", "observed_at", "kind")
    sinks.write_changes_by_jurisdiction(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == rows.count()
    assert set(json.loads(rows.select(sinks.json_rows(rows).alias("j")).first().j)) == set(rows.columns)
    assert json.loads(sinks.status_document(None, "t"))["state"] == "unknown"


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    b = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "change_id string, v int")
    append_new(b, 0, path, "change_id")
    append_new(b, 1, path, "change_id")
    assert spark.read.parquet(path).count() == 2


def test_fetcher():
    pages = {
        "https://h/robots.txt": (200, {}, b"User-agent: *\nDisallow: /no\nCrawl-delay: 5", None), "https://h/a": (200, {"Content-Type": "text/html"}, b"hi", None), "https://h/r": (302, {}, b"", "/a"),
        "https://h/loop": (302, {}, b"", "/loop"), "https://h/down": (302, {}, b"", "http://h/a"), "https://h/big": (200, {}, b"x" * (8 * 1024 * 1024 + 1), None), "https://h/404": (404, {}, b"", None),
    }

    def opener(url, limit):
        if url not in pages:
            raise OSError("no route")
        return pages[url]

    waits, clock = [], [0.0]
    f = PageFetcher(opener, sleep=lambda s: (waits.append(s), clock.__setitem__(0, clock[0] + s)), clock=lambda: clock[0])
    assert f.fetch("https://h/a")["ok"] and waits == []
    r = f.fetch("https://h/r")
    assert r["ok"] and r["final_url"] == "https://h/a" and r["redirect_chain"] == [{"status": 302, "url": "https://h/a"}] and waits == [5.0, 5.0]
    for url, why in (("http://h/a", "refused"), ("https://h/no", "refused"), ("https://h/down", "refused"), ("https://h/loop", "unreachable"), ("https://h/big", "body-too-large"), ("https://h/404", "http-error"), ("https://other/x", "unreachable")):
        got = f.fetch(url)
        assert not got["ok"] and got["error_class"] == why and got["body"] == b"", url


def test_fetch_all(spark):
    def opener(url, limit):
        return (404, {}, b"", None) if url.endswith("robots.txt") else (200, {"Content-Type": "text/plain"}, url.encode(), None)

    df = spark.createDataFrame([("https://a/1",), ("https://b/1",), (None,), ("https://a/1",)], "url string")
    got = {x.url: bytes(x.body) for x in fetch_all(df, "url", opener).collect()}
    assert got == {"https://a/1": b"https://a/1", "https://b/1": b"https://b/1"}
