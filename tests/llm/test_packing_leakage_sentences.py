import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import leakage, packing, queries, sentences


# --- packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_keeps_every_constraint(sizes):
    s = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    got = packing.best_fit(s, 50, 5, 1_800.0 + 2_500)
    for b in set(got.tolist()):
        own = s[got == b]
        assert own.sum() <= 50 and len(own) <= 5 and (own.astype(float) ** 2).sum() <= 4_300
    assert len(got) == len(s)


def test_the_attention_cost_binds_and_long_items_stand_alone():
    sizes = np.array([900, 800, 500, 400, 300, 300, 200, 100, 100])
    cost = 0.5 * 1000.0**2
    got = packing.best_fit(sizes, 1000, 100, cost)
    for k in set(got.tolist()):
        own = sizes[got == k].astype(float)
        assert own.sum() <= 1000 and ((own**2).sum() <= cost or len(own) == 1)
    scalar = packing.best_fit(sizes, 1000, 100, 1000.0**2)
    assert [set(np.flatnonzero(got == k)) for k in sorted(set(got))] != [set(np.flatnonzero(scalar == k)) for k in sorted(set(scalar))]


def test_equal_names_are_told_apart(spark):
    df = spark.createDataFrame([(i, "word " * 30) for i in range(20)], "doc_id bigint, text string")
    budgets = spark.createDataFrame([("b", 64), ("b", 128)], "budget_name string, capacity_tokens int")
    out = packing.pack(df, "doc_id", "text", budgets)
    assert {x.capacity_tokens for x in packing.fill(out).collect()} == {64, 128}
    assert out.groupBy("container_id").agg({"capacity_tokens": "min"}).count() == out.select("capacity_tokens", "container_id").distinct().count()
    assert all(x.n_broken == 0 and x.n_over == 0 and x.n_documents == 20 for x in packing.checks(out).collect())


def test_best_fit_is_tight_and_refuses():
    r = random.Random(1)
    s = np.array(sorted((r.randrange(1, 300) for _ in range(2_000)), reverse=True))
    n = len(set(packing.best_fit(s, 512, 512, 512.0**2).tolist()))
    assert n <= -(-s.sum() // 512) + 2
    with pytest.raises(ValueError):
        packing.best_fit(np.array([10]), 5, 5, 100.0)


def test_pack_round_trip(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["office", "页面", "é", "x1"]) for _ in range(r.randrange(1, 90)))) for i in range(200)] + [(900, None), (901, ""), (902, "word " * 2_000), (None, "lost")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    budgets = spark.createDataFrame([("s", 64), ("l", 512), ("none", None), ("zero", 0)], "budget_name string, capacity_tokens int")
    out = packing.pack(df, "doc_id", "text", budgets, group=60).toPandas()
    enc = packing.encoder()
    assert set(out["budget_name"]) == {"s", "l"}
    for name, cap in (("s", 64), ("l", 512)):
        own = out[out["budget_name"] == name]
        assert own.groupby("container_id")["n_tokens"].sum().max() <= cap
        for i, text in docs:
            n = len(enc.encode_ordinary(text)) if text and i is not None else 0
            pieces = own[own["doc_id"] == i].sort_values("piece_no") if i is not None else own[:0]
            assert pieces["n_tokens"].sum() == n
            assert len(pieces) == -(-n // cap)
            if n:
                assert list(pieces["token_start"]) == [cap * k for k in range(len(pieces))]
    assert packing.pack(df.filter("false"), "doc_id", "text", budgets).count() == 0
    assert packing.pack(df, "doc_id", "text", budgets.filter("false")).count() == 0
    fill = {x.budget_name: x for x in packing.fill(packing.pack(df, "doc_id", "text", budgets)).collect()}
    assert 0 <= fill["s"].unused_share < 0.05


# --- leakage


def plain_alignment(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = max(0, t[i, j] + (leakage.MATCH if a[i] == b[j] else leakage.MISMATCH), t[i, j + 1] + leakage.GAP, t[i + 1, j] + leakage.GAP)
    return int(t.max())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=14), st.lists(st.integers(0, 3), min_size=1, max_size=14))
def test_smith_waterman(a, b):
    score, pairs = leakage.local_alignment(np.array(a), np.array(b))
    assert score == plain_alignment(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len(pairs)


WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def test_leaks(spark):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, text(60)) for i in range(20)] + [(90, "科利顿的学校印了三十枚徽章却只付了五十二元押金奥伦镇无人反对窗口六应退还多少元"), (91, None), (92, ""), (93, "two words")]
    items += [(94, items[0][1]), (95, items[0][1].upper()), (96, items[0][1]), (97, items[0][1])]  # the same text many times
    w = items[1][1].split()
    edited = " ".join(r.choice(WORDS) if k % 9 == 4 else x.upper() for k, x in enumerate(w))
    docs = [
        (1, text(200) + " " + items[0][1] + " " + text(100)), (2, text(50) + ". " + edited + "; " + text(50)), (3, " ".join(w[:24]) + " " + text(30)), (4, " ".join(w[:9]) + " " + text(300)), (5, text(500)),
        (6, "开头。" + items[20][1][:20] + "，" + items[20][1][20:] + "结尾"), (7, None), (8, ""), (9, " ".join(w[:15]) + " " + text(12) + " " + " ".join(w[25:40])), (None, items[0][1]), (1, items[0][1]),
    ]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in leakage.find_leaks(d, "doc_id", "text", e, "item_id", "text").collect()}
    same = {0, 94, 95, 96, 97}
    assert got == {(1, i) for i in same} | {(2, 1), (3, 1), (6, 90), (9, 1)}
    assert leakage.find_leaks(d.filter("false"), "doc_id", "text", e, "item_id", "text").count() == 0
    assert leakage.find_leaks(d, "doc_id", "text", e.filter("false"), "item_id", "text").count() == 0


def test_leaks_with_replaced_words():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(m)) for i, m in enumerate([12, 15, 20, 40, 60, 120, 300, 900] * 4)]
    index = leakage.index_items(items)
    found, total = 0, 0
    for k, (_, t) in enumerate(items):
        w = t.split()
        for step in (4, 5, 6, 7, 8):
            for part in (0.45, 0.7, 1.0):
                off = r.randint(0, len(w) - int(len(w) * part))
                piece = w[off : off + int(len(w) * part)]
                edited = [r.choice(words) if j % step == step - 1 else x for j, x in enumerate(piece)]
                if sum(a == b for a, b in zip(piece, edited)) * 3 < len(w):
                    continue
                doc = f"{text(80)} {' '.join(edited)} {text(80)}"
                near = {a: (b, rare) for a, b, rare in leakage.candidates(index, *leakage.seeds(doc))}
                share = leakage.leaked_share(index.words[k], leakage.hashes(doc)[0], near[k][0])[0] if k in near else 0.0
                found, total = found + (share >= 1 / 3 and near[k][1] >= share * leakage.RARE), total + 1
    assert found >= 0.9 * total, (found, total)
    assert leakage.candidates(index, *leakage.seeds(text(2000))) == []


def test_pieces_of_a_long_item_follow_in_order():
    r = random.Random(6)
    text = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    item = text(1800)
    seedy = lambda doc: (leakage.hashes(" ".join(doc))[0], *next(iter([(p,) for _, p, _ in leakage.candidates(leakage.index_items([(1, " ".join(item))]), *leakage.seeds(" ".join(doc)))])))
    words = leakage.hashes(" ".join(item))[0]
    h, places = seedy(text(50) + item[:1200] + text(50))
    assert abs(leakage.leaked_share(words, h, places)[0] - 2 / 3) < 0.02
    h, places = seedy(text(50) + item[600:1200] + text(40) + item[:600] + text(50))
    assert leakage.leaked_share(words, h, places)[0] < 0.4


# --- sentences

ENGLISH = [
    ["The clerk keeps the log.", "Dr. Mara signs at 9 a.m. on Monday."], ["Ask Dr. Lunel at the desk.", "The fee is $4.50 today.", "Bring the form."], ['"Is this it?" asked the clerk.', "The St. Oslo annex is closed."],
    ["Mail goes with Mara & Co. on July 2.", "Please wait ... it can take days.", "Mail goes with Lunel & Co.", "The list is long.", "The log is open."], ["Requests are held.", "The clerk said no!", "Who signs?", "Bring Form A-1 (see Sec. 4.2 of the book)."],
]


def corpus():
    r = random.Random(4)
    docs, truth = [], {}
    for i in range(400):
        units, text = [], ""
        for p in range(3):
            if r.random() < 0.3:
                lo = len(text)
                text += r.choice(["Fees in Lunel", "Changes in Mara"])
                units.append((lo, len(text)))
                text += "\n"
            for s in r.sample([x for group in ENGLISH for x in group], 7):
                lo = len(text)
                text += s
                units.append((lo, len(text)))
                text += " "
            text = text.rstrip() + ("\n\n" if p < 2 else "")
        docs.append((i, text, r.choice(["en", "EN", "en-US", None])))
        truth[i] = units
    return docs, truth


def scores(got, truth):
    hit = sum(len(set(got[i]) & set(t)) for i, t in truth.items())
    return hit / sum(len(got[i]) for i in truth), hit / sum(map(len, truth.values()))


def test_learned_english(spark):
    docs, truth = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    models = sentences.learn(df, "text", "lang")
    assert {"dr", "co", "st", "sec", "a.m"} <= models["en"].abbreviations and "log" not in models["en"].abbreviations
    rows = sentences.split_documents(df, models, "doc_id", "text", "lang").toPandas()
    got = {i: list(zip(g["start_pos"], g["end_pos"])) for i, g in rows.groupby("doc_id")}
    p, r = scores(got, truth)
    assert p > 0.97 and r > 0.97, (p, r)


def test_rare_counts_are_learned_from(spark):
    # a short word, seen twice without a period and twice with one, among more words than 1 / 2e-5
    docs, _ = corpus()
    docs = [(i, t, "en") for i, t, _ in docs * 8]
    rare = ["The ox was late at the log. The clerk saw no ox. Dr. Mara waits. The ox is gone. Ask for ox. Bring Form A-1."]
    df = spark.createDataFrame([*docs, (9_999, rare[0], "en")], "doc_id bigint, text string, lang string").repartition(6)
    assert sum(len(t.split()) for _, t, _ in docs) > 200_000
    models = sentences.learn(df, "text", "lang")
    assert "ox" not in models["en"].abbreviations and {"dr", "co", "st"} <= models["en"].abbreviations
    cut = sentences.Splitter(models)
    text = "We wait for ox. Zunak pays."
    assert [text[a:b] for a, b in cut.split(text, "en")] == ["We wait for ox.", "Zunak pays."]


def test_long_words_that_end_sentences(spark):
    # never seen without a period and often, but what follows begins sentences
    docs, _ = corpus()
    docs = [(i, t + " Bring the guidebook. The list is long. Ask the guidebook. Mail goes with Lunel & Co. on July 2.", "en") for i, t, _ in docs * 2]
    models = sentences.learn(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), "text", "lang")
    assert "guidebook" not in models["en"].abbreviations and "co" in models["en"].abbreviations


def test_passages_in_small_letters_are_no_evidence(spark):
    docs, _ = corpus()
    cased = [(i, t + " Bring the stub. The list is long.", "en") for i, t, _ in docs]
    small = [(500 + i, "the clerk brought the stub. zunak pays. the list was held.", "en") for i in range(100)]
    models = sentences.learn(spark.createDataFrame([*cased, *small], "doc_id bigint, text string, lang string"), "text", "lang")
    assert "stub" not in models["en"].abbreviations and "co" in models["en"].abbreviations


def test_units_cover_all_and_edges(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    rows = queries.p9_found(spark, small).toPandas().sort_values(["doc_id", "start_pos"])
    text = dict(zip(d["doc_id"], d["text"]))
    for i, g in rows.groupby("doc_id"):
        t, at = text[i], 0
        for lo, hi in zip(g["start_pos"], g["end_pos"]):
            assert lo >= at and not t[at:lo].strip() and not t[lo].isspace() and not t[hi - 1].isspace()
            at = hi
        assert not t[at:].strip()
    assert set(rows["doc_id"]) == {i for i, t in text.items() if t and t.strip()}


def test_other_scripts_without_training():
    cut = sentences.Splitter({})
    units = lambda t, g: [t[a:b] for a, b in cut.split(t, g)]
    assert units("告示写着：“不收复印件。请带原件。”并盖章。请勿邮寄！", "zh") == ["告示写着：“不收复印件。请带原件。”并盖章。", "请勿邮寄！"]
    assert units("一覧\n- 旅行手帳\n現金は不可！", "ja") == ["一覧", "- 旅行手帳", "現金は不可！"]
    assert units("क्या यह है? हाँ। ठीक।", "hi") == ["क्या यह है?", "हाँ।", "ठीक।"]
    assert cut.split(None, None) == [] and cut.split(" \n ", "en") == [] and cut.split("", "xx") == []
    long = "word " * 50_000 + "end."
    assert cut.split(long, None) == [(0, len(long))]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert sentences.split_documents(df, sentences.learn(df, "text", "lang"), "doc_id", "text", "lang").count() == 0
    df = spark.createDataFrame([(None, "a", "en"), (1, None, None), (2, "One. Two.", "und"), (2, "One. Two.", "und")], "doc_id bigint, text string, lang string")
    got = sentences.split_documents(df, sentences.learn(df, "text", "lang"), "doc_id", "text", "lang").collect()
    assert sorted(tuple(x) for x in got) == [(2, 0, 4), (2, 0, 4), (2, 5, 9), (2, 5, 9)]
    assert isinstance(pd.DataFrame(got), pd.DataFrame)


def test_long_items_and_documents():
    r = random.Random(7)
    word = lambda: r.choice(WORDS)
    item = " ".join(word() for _ in range(2_000))
    ih, ig = leakage.hashes(item)[0], np.unique(leakage.seeds(item)[0])
    doc = " ".join(word() for _ in range(5_000)) + " " + item + " " + " ".join(word() for _ in range(5_000))
    g, at = leakage.seeds(doc)
    share, lo, hi = leakage.leaked_share(ih, leakage.hashes(doc)[0], at[np.isin(g, ig)])
    assert share > 0.99 and abs(lo - 5_000) < 10 and abs(hi - 7_000) < 10
    short = " ".join(item.split()[:40])
    ih, ig = leakage.hashes(short)[0], np.unique(leakage.seeds(short)[0])
    many = " ".join([short] * 3_000)
    g, at = leakage.seeds(many)
    assert leakage.leaked_share(ih, leakage.hashes(many)[0], at[np.isin(g, ig)])[0] == 1.0


def test_long_paragraphs_stay_linear():
    import time

    cut = sentences.Splitter({"en": sentences.Model()})
    for text, n in (("Some words here.\n" * 40_000, 40_000), ("line without an end\n" * 40_000, None), ("ประกาศ 71 ห้ามส่งเงิน " * 20_000, None), ('"Odd quote. ' * 30_000, None)):
        began = time.time()
        units = cut.split(text, "en")
        assert time.time() - began < 20 and units[-1][1] == len(text.rstrip())
        assert n is None or len(units) == n
