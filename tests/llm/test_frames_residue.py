import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import frames, queries, residue

SNAP = "snapshot_id bigint, url string, fetched_at timestamp_ntz, normalized_text string, site string, codes string"
MENU = "home | fees | news\nhome > fees > {t}\n"
FOOT = "\nwas this page useful? yes no\nmost read\nfees in x from may 2020\nopening hours, y branch\n© 2026 the office\npage last checked 2026-01-01\nour own tagline"
BODY = ["bring form {n}a and a photo.", "the counter in {n} is open daily.", "who may apply in {n}", "requests from {n} are held."]


def page(i, body=None):
    t = f"title {'abcdefghij'[i % 10]}"
    return f"{t}\n" + MENU.format(t=t) + "\n".join(body or [b.format(n="klmnopqrst"[i % 10] * 3) for b in BODY]) + FOOT


def frame(spark, rows):
    return spark.createDataFrame([(i, u, datetime(2026, 1, 5) + timedelta(hours=i or 0), t, "own", "x") for i, u, t in rows], SNAP)


def test_frame_lines(spark):
    rows = [(i, f"https://h/p/{i % 10}", page(i)) for i in range(30)]
    rows += [(50, "https://h/p/1", None), (51, None, "only a title"), (52, "https://lonely/", ""), (53, "https://h/zz/2?x=1", "w" * 300_000 + "\nbody."), (None, "https://h/p/1", "a\nb")]
    coded = frames.with_flags(frame(spark, rows))
    got = {x.snapshot_id: x.codes for x in coded.collect()}
    want = "TFFBBBBFFFFFFF"
    assert all(got[i] == want for i in range(30)), got[0]
    assert got[51] == "T" and got[52] == "T" and got[53] == "TB" and 50 not in got and None not in got
    lines = {(x.snapshot_id, x.line_no) for x in frames.frame_lines(coded, "snapshot_id").collect() if x.snapshot_id == 0}
    assert lines == {(0, n) for n in (2, 3, 8, 9, 10, 11, 12, 13, 14)}
    assert frames.with_flags(frame(spark, [])).count() == 0


def test_diff_frame_lines(spark):
    rows = [(i, f"https://h/p/{i}", page(i)) for i in range(8)]
    coded = frames.coded_texts(frame(spark, rows))
    diff = "@@ -1,3 +1,3 @@\n title a\n-home | fees | news\n+home | fees | news 2\n the counter in kkk is open daily.\n our own tagline\n+new line of text."
    changes = spark.createDataFrame([("c1", "https://h/p/0", diff), ("c1", "https://h/p/0", diff), ("c2", "https://h/p/1", None), ("c3", None, "@@ @@\n+home | fees | news\n+text."), (None, "https://h/p/1", "+home | fees | news")], "change_id string, url string, diff_excerpt string")
    got = sorted(tuple(x) for x in frames.diff_frame_lines(changes, coded, frames.flagged(coded)).collect())
    assert got == [("c1", 3), ("c1", 4), ("c1", 6), ("c3", 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12), st.sampled_from([1, 8, 1 << 28]))
def test_lcs_is_longest(a, b, bits):
    def longest(x, y):
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    got = frames.lcs_keys(list(a), list(b), bits)
    assert len(got) == longest(a, b)
    for side in (a, b):
        it = iter(side)
        assert all(x in it for x in got)


def test_residue_lines():
    for line in ("{{ hours }}", "address: ${address}", "[%link%]", "[body tbd]", "[insert date here]", "titre: [[titre]]", "lorem lorem lorem", "... ... ... ..."):
        assert residue.residue_class(line), line
    for line in ("call {{phone}} to ask about the card.", "write [insert date here] in box 72 of form ba-995.", "error 404", "2024", ""):
        assert not residue.residue_class(line), line


WEB = "snapshot_id bigint, url string, fetched_at timestamp_ntz, normalized_text string, http_status int, raw_bytes binary, site string"


def web(spark, rows):
    return spark.createDataFrame([(i, u, datetime(2026, 1, 5) + timedelta(hours=i or 0), t, s, b, "own") for i, u, t, s, b in rows], WEB)


def test_residue_pages(spark):
    rows = [(100 * h + i, f"https://h{h}/p/{i}", page(i, [f"{w} {'klmnopqrst'[i] * 3}{h}x may bring {w} papers along." for w in ("they", "those", "others", "clerks")]), 200, None) for h in range(3) for i in range(10)]
    # messages in words no list holds, on several hosts and under several titles
    rows += [(1000 + h, f"https://h{h}/q/{h}", f"{'abc'[h] * 5} office\nzugriff vorerst gesperrt\nspäter erneut versuchen.", 200, None) for h in range(3)]
    rows += [(1010, "https://h1/q/x", "other title\nspäter erneut versuchen.\nvorgang kkkk 12", 503, None), (1011, "https://h1/q/y", "other title y\nspäter erneut versuchen.\nbring form kkk-1 and a photo of your own.", 200, None)]
    rows += [(1012, "https://h1/q/z", "a portal\nseite wird aufgebaut", None, b"<html><body><div id='a'></div><script src='x'></script>"), (1013, "https://h1/q/w", "counter\nbring form kkk-2 today.", 404, b"\xff<p>bring")]
    rows += [(1014, "https://h2/q/3", "sample\nlorem ipsum vestro amora.\nvestro amora ipsum.\namora vestro amora vestro.", 200, None), (1015, "https://h2/q/4", "", None, None), (1016, None, None, None, None), (1017, "https://h2/q/5", "{{ title }}", 200, None)]
    out = residue.residue_evidence(web(spark, rows))
    assert {x.snapshot_id for x in out.filter("residue").collect()} == {1000, 1001, 1002, 1010, 1012, 1014, 1017}
    assert out.filter("snapshot_id = 1016").count() == 0
    assert residue.residue_evidence(web(spark, [])).count() == 0


def test_queries_run(spark, small):
    found = {x.snapshot_id for x in queries.p4_found(spark, small).collect()}
    kept = {x.snapshot_id for x in queries.p4_kept(spark, small).collect()}
    assert found and not found & kept and len(found) + len(kept) == spark.read.parquet(f"{small}/snapshots.parquet").count()
    p6 = queries.p6_found(spark, small)
    assert {x.rec_table for x in p6.select("rec_table").distinct().collect()} == {"snapshots", "changes"}
    main = {x.snapshot_id: x.main_text for x in queries.p6_main_text(spark, small).collect()}
    assert len(main) == len(found) + len(kept)


def test_shared_lines_need_no_word_list(spark):
    def german(i):
        t = f"gebühren {'abcdefghij'[i]}"
        body = [f"der schalter {'klmnopqrst'[i] * 3} ist offen.", "unterlagen", f"antrag {'klmnopqrst'[i] * 4} bitte mitbringen.", "alle angaben ohne gewähr."]
        return "\n".join([t, "startseite", "amt und bürger", f"startseite > ämter > {t}", "diese seite speichert daten im gerät.", "ablehnen", "zustimmen", *body, "nach oben springen und dort noch einmal alle weiteren dienste des amtes ansehen"])

    same = "kopie\nüberschrift der kopie\nein satz der kopie."
    rows = [(i, f"https://de/p/{i}", german(i)) for i in range(8)] + [(20 + i, f"https://mirror/p/{i}", same) for i in range(4)]
    got = {x.snapshot_id: x.codes for x in frames.with_flags(frame(spark, rows)).collect()}
    assert {got[i] for i in range(8)} == {"TFFFFFFBBBBF"}
    assert {got[20 + i] for i in range(4)} == {"TBB"}


def test_every_text_of_a_page_is_aligned(spark):
    def old(i, line):
        return "\n".join([f"titel {'abcdefgh'[i]}", f"der schalter {'klmnopqr'[i] * 3} ist offen.", f"antrag {'klmnopqr'[i] * 4} bitte mitbringen.", line])

    rows = [(i, f"https://de/p/{i}", old(i, "frühere fußzeile des amtes")) for i in range(6)] + [(100 + i, f"https://de/p/{i}", old(i, "neue fußzeile des amtes")) for i in range(6)]
    rows += [(200 + i, f"https://query/page?id={i}", old(i, "fußzeile der abfragen")) for i in range(6)]
    got = {x.snapshot_id: x.codes for x in frames.with_flags(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and set(got.values()) == {"TBBF"}, got


def test_evidence_is_of_the_whole_body(spark):
    rows = [(1, "https://h/fees/1", "\n".join(["fees today", "the fees desk is open daily.", *["{{ hours }}"] * 9]))]
    got = residue.residue_evidence(web(spark, [(*x, None, None) for x in rows])).collect()[0]
    assert (got.n_body, got.n_bad, got.overlap, got.residue) == (10, 9, 1, False)


def invented_site(r, host, n):
    """Pages of one site in words made up for this run, and their frame lines."""
    syllables = ["ka", "lo", "mi", "ru", "te", "so", "na", "vi", "pe", "du"]
    word = lambda: "".join(r.choice(syllables) for _ in range(3))
    some = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    menu, consent, buttons, prompt, head = [some(1, 3) for _ in range(5)], some(6, 9) + ".", [some(1, 2), some(1, 2)], some(3, 5), some(2, 3)
    foot, notice, about = [some(3, 5), some(2, 4) + " 2026"], some(5, 8) + ".", [word() for _ in range(4)]
    out = []
    for i in range(n):
        title = f"{r.choice(about)} {some(2, 3)}"
        top = [*menu, f"{menu[0]} > {title}"]
        body = [some(6, 12) + "." for _ in range(r.randint(5, 9))]
        body.insert(r.randrange(1, len(body)), notice)
        body.insert(r.randrange(1, len(body)), some(2, 4))
        cut = r.randrange(1, len(body) + 1) if i % 2 else len(body)
        side = [head, *[f"{r.choice(about)} {some(2, 3)}" for _ in range(r.randint(2, 3))]]
        end = [*foot, consent, *buttons]
        body = [(x, False) for x in body[:cut]] + [(prompt, True)] * (i % 3 > 0) + [(x, False) for x in body[cut:]]
        lines = [(title, False), *[(x, True) for x in top], *body, *[(x, True) for x in (side if i % 4 else [])], *[(x, True) for x in end]]
        out.append((f"https://{host}/a/{i:02d}", lines))
    return out


def test_the_alignment_finds_the_frame_in_invented_words(spark):
    r = random.Random(7)
    pages = [x for h in range(6) for x in invented_site(r, f"h{h}", 10)]
    texts = ["\n".join(x for x, _ in lines) for _, lines in pages]
    rows = [(i, u, t) for i, ((u, _), t) in enumerate(zip(pages, texts))]
    got = {x.snapshot_id: x.codes for x in frames.with_flags(frame(spark, rows)).collect()}
    want = {(i, n) for i, (_, lines) in enumerate(pages) for n, (_, f) in enumerate(lines) if f}
    found = {(i, n) for i, c in got.items() for n, x in enumerate(c) if x == "F"}
    both = len(want & found)
    assert both >= 0.95 * len(want) and both >= 0.95 * len(found), (len(want), len(found), both, [pages[i][1][n][0] for i, n in (want ^ found)][:20])
    # without shared lines next to nothing goes
    alone = sum(frames.codes_of(frames.lines_of(t.split("\n")), set()).count("F") for t in texts)
    assert alone <= 0.15 * both


def test_long_pages_align_in_bounded_memory():
    a = list(range(30_000))
    b = [x for x in a if x % 3] + [7] * 2_000
    got = frames.lcs_keys([-1, *a], [-2, *b], 1 << 24)
    assert got == [x for x in a if x % 3]
