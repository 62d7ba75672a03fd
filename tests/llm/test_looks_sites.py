import random
import unicodedata as ud
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import looks, queries, sites
from tidemark.llm.looks import canonical

ALIKE = [
    ("ｆｅｅｓ　１２", "fees 12"), ("été", "été"), ("ﬁle oﬃce", "file office"), ("а соре", "a cope"), ("fe​e­s⁣", "fees"), ("a b c", "a b c"),
    ("理由", "理由"), ("ｶﾞ", "ガ"), ("ոоԝ", "now"), ("сбop", "сбор"), ("e‍́", "é"), ("ﾊﾟ", "パ"), ("한", "한"), ("ﻻ", "لا"),
]
APART = [("é", "e"), ("1", "2"), ("a\nb", "ab"), ("“a”", '"a"'), ("a.", "a"), ("²", "2"), ("№", "No"), ("сбор", "cbop"), ("й", "и")]


def test_alike_and_apart():
    for a, b in ALIKE:
        assert canonical(a) == canonical(b), (a, b, canonical(a), canonical(b))
    for a, b in APART:
        assert canonical(a) != canonical(b), (a, b)
    assert canonical(None) is None and canonical("") == ""


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeé́̀ \nｅ１ﬁа​о̧сｶﾞ한ᅡ理x."), max_size=40))
def test_canonical_is_stable(t):
    c = canonical(t)
    assert canonical(c) == c
    assert c.count("\n") == t.count("\n")
    assert canonical(ud.normalize("NFD", t)) == canonical(ud.normalize("NFC", t))


def test_splicing_equals_whole_normalization():
    r = random.Random(1)
    for _ in range(300):
        t = "".join(r.choice("abe ȩ́́̀uiｅo") for _ in range(30))
        assert canonical(t) == ud.normalize("NFC", ud.normalize("NFC", t).replace("ｅ", "e"))


def test_with_canonical(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, "ｅ" * 200_000, "x"), (5, "a\tb", "x")]
    got = {x.i: x.c for x in looks.with_canonical(spark.createDataFrame(rows, "i int, t string, form string"), "t", "c").collect()}
    assert got[1] is None and got[2] == "" and got[3] == "plain" and got[4] == "e" * 200_000 and got[5] == "a b"
    assert looks.with_canonical(spark.createDataFrame([], "i int, t string"), "t", "c").count() == 0


def test_p1_found_against_brute_force(spark, small):
    s = spark.read.parquet(f"{small}/snapshots.parquet").toPandas().sort_values(["source_id", "fetched_at", "snapshot_id"])
    want, last = set(), None
    for r in s.itertuples():
        if last is not None and last.source_id == r.source_id and last.normalized_text != r.normalized_text and canonical(last.normalized_text) == canonical(r.normalized_text):
            want.add((min(last.snapshot_id, r.snapshot_id), max(last.snapshot_id, r.snapshot_id)))
        last = r
    assert {tuple(x) for x in queries.p1_found(spark, small).collect()} == want and want


def brute_lines(rows, least):
    key = lambda x: "".join(c for c in (canonical(x) or "").lower() if ud.category(c)[0] in "LM")
    by = defaultdict(set)
    for _, src, site, text in rows:
        for line in (text or "").split("\n"):
            if src is not None:
                by[site, key(line)].add(src)
    return {(i, n) for i, _, site, text in rows for n, line in enumerate((text or "").split("\n"), 1) if text is not None and key(line) and len(by[site, key(line)]) >= least}


def test_p3_found_against_brute_force(spark, small):
    s = spark.read.parquet(f"{small}/snapshots.parquet").select("snapshot_id", "source_id", sites.site_of(F.col("url")).alias("site"), "normalized_text").collect()
    assert {tuple(x) for x in queries.p3_found(spark, small).collect()} == brute_lines([tuple(x) for x in s], 5)


def test_repeated_lines_edges(spark):
    rows = [(i, f"s{i % 6}", f"https://WWW.h:443/{i}", "Share, this 1\nown " + "abcdefgh"[i % 8] + "\n\n123") for i in range(60)]
    rows += [(100, None, "https://h/x", "share this\nbody"), (101, "s1", None, "share this"), (102, "s1", "https://h/y", None), (103, "s1", "https://h/y", "")]
    df = spark.createDataFrame(rows, "snapshot_id bigint, source_id string, url string, normalized_text string")
    lines = sites.repeated_lines_of(df, "snapshot_id", "source_id", "url", "normalized_text", 5)
    got = {(x.snapshot_id, x.line_no) for x in lines.collect()}
    assert {(i, 1) for i in range(60)} <= got and (100, 1) in got and (101, 1) not in got
    assert all(n == 1 for _, n in got)
    clean = {x.snapshot_id: x.out for x in sites.without_lines(df, "snapshot_id", "normalized_text", lines, "out").collect()}
    assert clean[0] == "own a\n\n123" and clean[100] == "body" and clean[102] is None and clean[103] == ""
    empty = df.filter("false")
    assert sites.repeated_lines_of(empty, "snapshot_id", "source_id", "url", "normalized_text").count() == 0


def test_site_of(spark):
    urls = {"https://www.A.b:8080/x": "a.b", "http://u:p@C.d?x": "c.d", "HTTPS://e.f.:443/": "e.f", "nonsense": "", "https://www.www.x/": "www.x"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", sites.site_of(F.col("u")).alias("s")).collect()
    assert {x.u: x.s for x in got} == urls


def test_a_russian_line_stays_russian():
    line = "оно с вами, а он со мной: у нас тот сбор"
    assert looks.canonical(line) == line
    assert looks.canonical(line.replace("с ", "c ")) == line  # a Latin c
    assert looks.canonical("а сору of the form") == "a copy of the form"  # Cyrillic letters in an English line
    assert looks.canonical("сору") == "copy"


def test_repeated_lines_by_share_and_by_shuffle(spark, monkeypatch):
    rows = [(i, f"s{i}", "https://h/p", "common line\nhalf line" if i < 5 else "common line") for i in range(12)]
    df = spark.createDataFrame(rows, "snapshot_id bigint, source_id string, url string, normalized_text string")
    cols = ("snapshot_id", "source_id", "url", "normalized_text")
    want = {(i, 1) for i in range(12)} | {(i, 2) for i in range(5)}
    found = lambda **k: {(x.snapshot_id, x.line_no) for x in sites.repeated_lines_of(df, *cols, **k).collect()}
    assert found() == want
    assert found(min_share=0.5) == {(i, 1) for i in range(12)}
    monkeypatch.setattr(sites, "BROADCAST_ROWS", 0)
    assert found() == want
