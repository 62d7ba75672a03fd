import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.claims import drifted_claims, number_claims, silent_texts
from tidemark.plans.ordered import positions, previous_row, range_blocks
from tidemark.sources import sinks
from tidemark.sources.store import RunStore


def test_positions(spark):
    r = random.Random(1)
    rows = [(r.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "v int, id int")
    got = {x.id: x.place for x in positions(df, [F.col("v").desc_nulls_last(), F.col("id").asc()], "place").collect()}
    want = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [got[i] for _, i in want] == list(range(1, 501))
    assert positions(df.filter("false"), [F.col("id")], "place").count() == 0


def test_range_blocks_split_one_key(spark):
    df = spark.createDataFrame([("hot", i) for i in range(400)] + [("a", 1), (None, 2)], "k string, id int")
    blocked = range_blocks(df, ["k", "id"])
    assert blocked.filter("k = 'hot'").select("__tm_range").distinct().count() > 1
    got = {(x.k, x.id): x.prev.id if x.prev else None for x in previous_row(blocked, ["k"], ["id"], F.col("__tm_range"), ["id"]).collect()}
    assert got == {("hot", i): i - 1 if i else None for i in range(400)} | {("a", 1): None, (None, 2): None}


def test_run_store(spark, tmp_path):
    root, schemas = str(tmp_path / "store"), {"attempts": "source_id string, n int", "runs": "state string"}
    store = RunStore(spark, root, schemas)
    assert store.read("attempts").count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], schemas["attempts"])
    store.append("r1", {"attempts": rows}, {"state": "complete"})
    rows.write.parquet(f"{root}/attempts/run_id=half")  # a run that died before its manifest
    assert sorted(tuple(x) for x in store.read("attempts").collect()) == [("a", 1, "r1"), ("b", 2, "r1")]
    for bad in ("r1", "../x"):
        with pytest.raises(ValueError):
            store.append(bad, {"attempts": rows})
    with pytest.raises(ValueError):
        store.append("r2", {"attempts": rows.withColumnRenamed("n", "m")})
    assert RunStore(spark, root, schemas).committed() == ["r1"]
    with pytest.raises(ValueError):
        RunStore(spark, root, {"attempts": "source_id string"})
    assert json.load(open(f"{root}/manifests/r1.json"))["receipt"] == {"state": "complete"}
    assert not [n for n in os.listdir(root) if n.endswith(".new")]


def test_claims(spark):
    texts = spark.createDataFrame([("a.md", "We watch 1,250 sources in 52 places. Now 1,251 sources."), ("b.md", "nothing"), ("c.md", None)], "path string, value string")
    claims = number_claims(texts, {"sources": r"([\d,]+) sources", "places": r"(\d+) places"})
    counted = spark.createDataFrame([("sources", 1250), ("places", 52)], "claim string, counted bigint")
    assert [tuple(x) for x in drifted_claims(claims, counted).collect()] == [("a.md", "sources", 1251, 1250)]
    assert sorted(x.path for x in silent_texts(texts, claims).collect()) == ["b.md", "c.md"]


def test_registry_document():
    entries = [{"id": "a", "verification": {"status": "verified", "note": "a {b} \"c\""}, "hosts": ["x", "y"]}]
    text = sinks.registry_document(entries, [])
    assert json.loads(text)["sources"] == entries and '{"status": "verified"' in text


def test_site_and_receipts(spark, tmp_path):
    df = spark.createDataFrame([("<b>", None)], "a string, b int")
    page = sinks.site_page("A & B", df, ["a", "b"])
    assert "&lt;b&gt;" in page and "A &amp; B" in page and "<b>" not in page
    sinks.receipt_lines(df, str(tmp_path / "r"))
    sinks.receipt_lines(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_jurisdiction_artifacts(spark, small):
    out = sinks.jurisdiction_artifacts(spark.read.parquet(f"{small}/changes.parquet"), ["US", "ZZ"])
    assert set(out) == {"feeds/us.xml", "us.html", "feeds/us-zz.xml", "us-zz.html"} and "nothing published" in out["feeds/us-zz.xml"]
