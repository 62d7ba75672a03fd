import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.deltas import delivery_counts, snapshot_deltas
from tidemark.operators.orphans import orphan_counts, orphan_references

SNAP = "source_id string, w int, at timestamp_ntz, id bigint, text string, sha string, k1 string, bucket string"
T0 = datetime(2026, 1, 5)


def brute(rows):
    last = {}
    for s, w, at, i, text, *_ in rows:
        if s is not None and w is not None and (s, w) not in last or s is not None and w is not None and (at, i) > last[s, w][0]:
            last[s, w] = ((at, i), text)
    weeks = [w for _, w in last]
    out = set()
    for (s, w) in last:
        if w > min(weeks) and (s, w - 1) not in last:
            out.add((s, w, "added"))
        if w < max(weeks) and (s, w + 1) not in last:
            out.add((s, w + 1, "removed"))
        if (s, w - 1) in last and last[s, w][1] != last[s, w - 1][1]:
            out.add((s, w, "changed"))
    return out


def deltas(spark, rows, **k):
    df = spark.createDataFrame(rows, SNAP)
    return snapshot_deltas(df, "source_id", "w", ["at", "id"], "text", ["sha"], **k)


def test_deltas_match_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(800):
        w = r.choice([0, 1, 2, 4])
        rows.append((r.choice([None, "hot", *[f"s{k}" for k in range(40)]]), w, T0 + timedelta(hours=r.randrange(5)), i, r.choice([None, "", "a", "b"]), "h", "x", "y"))
    rows += rows[:50]  # repeated rows
    got = {(x.source_id, x.w, x.change_kind) for x in deltas(spark, rows, rows_per_bucket=50).collect()}
    assert got == brute(rows)


def test_deltas_values_and_counts(spark):
    rows = [("a", 0, T0, 1, "old", "1", "", ""), ("a", 1, T0, 2, "new", "2", "", ""), ("b", 0, T0, 3, "x" * 100_000, None, "", ""), ("c", 1, T0, 4, None, None, "", "")]
    d = deltas(spark, rows)
    got = {x.source_id: x for x in d.collect()}
    assert (got["a"].old_text, got["a"].new_text, got["a"].old_sha, got["a"].new_sha) == ("old", "new", "1", "2")
    assert got["b"].change_kind == "removed" and len(got["b"].old_text) == 100_000 and got["b"].new_text is None
    assert got["c"].change_kind == "added"
    assert {(x.w, x.change_kind, x.n_sources) for x in delivery_counts(d, "w").collect()} == {(1, "changed", 1), (1, "removed", 1), (1, "added", 1)}


def test_deltas_of_nothing(spark):
    assert deltas(spark, []).count() == 0
    assert deltas(spark, [(None, 0, T0, 1, "x", "", "", "")]).count() == 0


def test_orphans_match_brute_force(spark):
    r = random.Random(5)
    t = lambda: T0 + timedelta(days=r.randrange(40), hours=r.randrange(3))
    parents = [(r.choice(["A", "b ", "c", "d", None]), r.choice([None, t(), t(), t()]), r.choice([None, t(), t()]), 1) for _ in range(14)]
    refs = [(r.choice(["changes", "snaps"]), str(i), r.choice([" a", "B", "\tC ", "d", "e", None, "hot"]), r.choice([t(), t(), t(), None])) for i in range(400)]
    refs += refs[:20]
    out = set()
    fold = lambda x: x.strip().lower()
    for table, key, rid, at in refs:
        if rid is None:
            continue
        own = [(f or datetime.min, u or datetime.max) for i, f, u, _ in parents if i is not None and fold(i) == fold(rid)]
        month = at.strftime("%Y-%m") if at else None
        if not own:
            out.add((table, key, month, "missing"))
        elif at and not any(f <= at < u for f, u in own):
            out.add((table, key, month, "late" if all(f > at for f, _ in own) else "deleted"))
    p = spark.createDataFrame(parents, "id string, valid_from timestamp_ntz, valid_to timestamp_ntz, ref_key int")
    q = spark.createDataFrame(refs, "ref_table string, ref_key string, ref_id string, ref_at timestamp_ntz")
    got = orphan_references(q, p)
    assert {tuple(x) for x in got.collect()} == out
    assert sum(x.n_refs for x in orphan_counts(got).collect()) == len(out)


def test_orphans_of_empty_tables(spark):
    p = spark.createDataFrame([], "id string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    q = spark.createDataFrame([("t", "1", "x", T0)], "ref_table string, ref_key string, ref_id string, ref_at timestamp_ntz")
    assert [x.reason for x in orphan_references(q, p).collect()] == ["missing"]
    assert orphan_references(q.filter(F.lit(False)), p).count() == 0
