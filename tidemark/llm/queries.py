"""Queries of the problems on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import frames, leakage, looks, packing, residue, sentences, sites
from tidemark.plans.ordered import previous_in_order
from tidemark.session import durable, spread
from tidemark.sources.tables import table


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot's text in its one form, with whether it had to change."""
    s = looks.with_canonical(spread(table(spark, d, "snapshots", "snapshot_id", "normalized_text")), "normalized_text", "canonical_text")
    return s.select("snapshot_id", "canonical_text", (~F.col("canonical_text").eqNullSafe(F.col("normalized_text"))).alias("rewritten"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring snapshots of a source whose texts differ but look the same."""
    s = spread(table(spark, d, "snapshots", "snapshot_id", "source_id", "fetched_at", "normalized_text")).filter(F.col("source_id").isNotNull() & F.col("normalized_text").isNotNull())
    s = looks.with_canonical(s, "normalized_text", "form")
    t1, t2 = looks.look_hash(F.col("normalized_text"))
    f1, f2 = looks.look_hash(F.col("form"))
    compact = s.select("snapshot_id", "source_id", "fetched_at", F.struct(t1.alias("a"), t2.alias("b")).alias("raw"), F.struct(f1.alias("a"), f2.alias("b")).alias("look"))
    # written down first: range partitioning samples its input, which would rewrite every text twice
    near = previous_in_order(durable(compact), ["source_id"], ["fetched_at", "snapshot_id"], ["snapshot_id", "raw", "look"])
    alike = near.filter((F.col("prev.look") == F.col("look")) & (F.col("prev.raw") != F.col("raw")))
    return alike.select(
        F.least("snapshot_id", "prev.snapshot_id").cast("bigint").alias("snapshot_id_a"), F.greatest("snapshot_id", "prev.snapshot_id").cast("bigint").alias("snapshot_id_b")).distinct()


def _repeated(spark: SparkSession, d: str, **threshold: float) -> DataFrame:
    s = spread(table(spark, d, "snapshots", "snapshot_id", "source_id", "url", "normalized_text"))
    return sites.repeated_lines_of(s, "snapshot_id", "source_id", "url", "normalized_text", **threshold)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that stand on at least five sources of their site."""
    return _repeated(spark, d).select(F.col("snapshot_id").cast("bigint").alias("snapshot_id"), F.col("line_no").cast("int").alias("line_no")).distinct()


def p3_widespread(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots' lines that stand on at least half of their site's sources, and on five."""
    return _repeated(spark, d, min_share=0.5).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_lines"))


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot's text without the lines its site repeats."""
    s = table(spark, d, "snapshots", "snapshot_id", "normalized_text")
    return sites.without_lines(s, "snapshot_id", "normalized_text", _repeated(spark, d), "cleaned_text").select("snapshot_id", "cleaned_text")


def _pages(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "snapshots", "snapshot_id", "url", "fetched_at", "normalized_text", *more))


def p4_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for and against each snapshot being residue."""
    return residue.residue_evidence(_pages(spark, d, "http_status", "raw_bytes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots that hold nothing but template residue, filler or messages."""
    return p4_evidence(spark, d).filter("residue").select("snapshot_id").distinct()


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots without residue."""
    s = table(spark, d, "snapshots", "snapshot_id", "source_id", "fetched_at")
    return s.join(p4_found(spark, d), "snapshot_id", "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Frame lines of snapshots and of changes."""
    coded = frames.coded_texts(_pages(spark, d))
    flags = durable(frames.flagged(coded))
    changes = table(spark, d, "changes", "change_id", "url", "diff_excerpt")
    snaps = frames.frame_lines(flags, "snapshot_id").select(F.lit("snapshots").alias("rec_table"), F.col("snapshot_id").cast("string").alias("rec_key"), "line_no")
    diffs = frames.diff_frame_lines(changes, coded, flags).select(F.lit("changes").alias("rec_table"), F.col("change_id").alias("rec_key"), "line_no")
    return snaps.unionByName(diffs).distinct()


def p6_main_text(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot's text with only the title and the main body kept."""
    s = table(spark, d, "snapshots", "snapshot_id", "normalized_text")
    lines = frames.frame_lines(frames.with_flags(_pages(spark, d)), "snapshot_id")
    return sites.without_lines(s, "snapshot_id", "normalized_text", lines, "main_text").select("snapshot_id", "main_text")


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every document's containers, for each size."""
    return packing.pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "token_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p7_assignment(spark, d))


def p7_spread_cost(spark: SparkSession, d: str) -> DataFrame:
    """The fill where the attention cost binds, at most two fifths of that of one document that fills a container."""
    return packing.fill(packing.pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "token_budgets"), cost_share=0.4, weights=(1.0, 0.02, 1.0)))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """That every document is placed once, whole, and no container is over its size."""
    return packing.checks(p7_assignment(spark, d))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items they leak, the share found and where."""
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Test items by the number of documents they leak into."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence, heading and list item of every document."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return sentences.split_documents(docs, sentences.learn(docs, "text", "lang"), "doc_id", "text", "lang").distinct()


def p9_units_per_document(spark: SparkSession, d: str) -> DataFrame:
    units = p9_found(spark, d)
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Characters in each document's units but white space; every one of the document's must be in one unit."""
    docs = table(spark, d, "documents", "doc_id", "text")
    units = p9_found(spark, d).join(docs, "doc_id")
    own = F.substring("text", (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int"))
    return units.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace(own, _SPACE, ""))).alias("n_chars"))


_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

QUERIES = {
    "p1_found": p1_found,
    "p1_canonical": p1_canonical,
    "p3_found": p3_found,
    "p3_cleaned": p3_cleaned,
    "p3_widespread": p3_widespread,
    "p4_found": p4_found,
    "p4_evidence": p4_evidence,
    "p4_kept": p4_kept,
    "p6_found": p6_found,
    "p6_main_text": p6_main_text,
    "p7_assignment": p7_assignment,
    "p7_fill": p7_fill,
    "p7_spread_cost": p7_spread_cost,
    "p7_checks": p7_checks,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p8_leaked_items": p8_leaked_items,
    "p9_found": p9_found,
    "p9_units_per_document": p9_units_per_document,
    "p9_coverage": p9_coverage,
}
ORACLES: dict[str, str] = {
    "p7_checks": "SELECT budget_name, CAST(capacity_tokens AS BIGINT) AS capacity_tokens, n_documents, 0 AS n_broken, 0 AS n_over FROM token_budgets, (SELECT count(DISTINCT doc_id) AS n_documents FROM documents WHERE text <> '')",
    "p9_coverage": f"SELECT doc_id, n_chars FROM (SELECT doc_id, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS n_chars FROM documents) WHERE n_chars > 0",
}
