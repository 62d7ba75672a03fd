"""Queries p2 and p5 over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.deltas import delivery_counts, snapshot_deltas
from tidemark.operators.orphans import orphan_counts, orphan_references
from tidemark.sources.tables import table


def _week_deltas(spark: SparkSession, d: str) -> DataFrame:
    snaps = table(spark, d, "snapshots", "snapshot_id", "source_id", "fetched_at", "normalized_text", "content_sha256")
    # 1969-12-29 is a Monday; whole weeks since then number the deliveries
    week = F.floor((F.datediff(F.to_date("fetched_at"), F.lit("1970-01-05").cast("date"))) / 7).cast("int")
    deltas = snapshot_deltas(snaps.withColumn("week_no", week), "source_id", "week_no", ["fetched_at", "snapshot_id"], "normalized_text", ["content_sha256"])
    start = F.date_format(F.date_add(F.lit("1970-01-05").cast("date"), F.col("week_no") * 7), "yyyy-MM-dd")
    return deltas.withColumn("week_start", start)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources added, removed or changed between successive weeks."""
    return _week_deltas(spark, d).select("source_id", "week_start", "change_kind")


def p2_weekly_counts(spark: SparkSession, d: str) -> DataFrame:
    return delivery_counts(_week_deltas(spark, d), "week_start").select("week_start", "change_kind", "n_sources")


def p2_changed_values(spark: SparkSession, d: str) -> DataFrame:
    """The delta with the recorded hashes and the texts' sizes on both sides."""
    x = _week_deltas(spark, d)
    return x.select(
        "source_id", "week_start", "change_kind", "old_content_sha256", "new_content_sha256",
        F.length("old_normalized_text").cast("bigint").alias("old_chars"), F.length("new_normalized_text").cast("bigint").alias("new_chars"),
    )


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    changes = table(spark, d, "changes", "change_id", "source_id", "observed_at").select(
        F.lit("changes").alias("ref_table"), F.col("change_id").alias("ref_key"), F.col("source_id").alias("ref_id"), F.col("observed_at").alias("ref_at"))
    snaps = table(spark, d, "snapshots", "snapshot_id", "source_id", "fetched_at").select(
        F.lit("snapshots").alias("ref_table"), F.col("snapshot_id").cast("string").alias("ref_key"), F.col("source_id").alias("ref_id"), F.col("fetched_at").alias("ref_at"))
    parents = table(spark, d, "sources", "source_id", "registered_at", "retired_at").select(
        F.col("source_id").alias("id"), F.col("registered_at").alias("valid_from"), F.col("retired_at").alias("valid_to"))
    return changes.unionByName(snaps), parents


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that name a source the registry does not hold at their time."""
    return orphan_references(*_references(spark, d))


def p5_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p5_found(spark, d))


QUERIES = {
    "p2_found": p2_found,
    "p2_weekly_counts": p2_weekly_counts,
    "p2_changed_values": p2_changed_values,
    "p5_found": p5_found,
    "p5_orphans_by_month": p5_orphans_by_month,
}

_P2 = """
WITH s AS (SELECT source_id, CAST(date_trunc('week', fetched_at) AS DATE) AS wk, normalized_text, content_sha256,
    row_number() OVER (PARTITION BY source_id, date_trunc('week', fetched_at) ORDER BY fetched_at DESC, snapshot_id DESC) AS rn
  FROM snapshots WHERE source_id IS NOT NULL AND fetched_at IS NOT NULL),
r AS (SELECT * FROM s WHERE rn = 1),
b AS (SELECT min(wk) AS lo, max(wk) AS hi FROM r),
j AS (SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.wk, CAST(o.wk + INTERVAL 7 DAY AS DATE)) AS wk,
    n.source_id AS ns, o.source_id AS os, n.normalized_text AS nt, o.normalized_text AS ot, n.content_sha256 AS nh, o.content_sha256 AS oh
  FROM r n FULL OUTER JOIN r o ON n.source_id = o.source_id AND n.wk = CAST(o.wk + INTERVAL 7 DAY AS DATE)),
d AS (SELECT source_id, strftime(wk, '%Y-%m-%d') AS week_start,
    CASE WHEN os IS NULL THEN 'added' WHEN ns IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    oh AS old_content_sha256, nh AS new_content_sha256, CAST(length(ot) AS BIGINT) AS old_chars, CAST(length(nt) AS BIGINT) AS new_chars
  FROM j, b WHERE wk > lo AND wk <= hi AND (os IS NULL OR ns IS NULL OR nt IS DISTINCT FROM ot))
"""

_P5 = """
WITH refs AS (
  SELECT 'changes' AS ref_table, change_id AS ref_key, regexp_replace(lower(source_id), '^\\s+|\\s+$', '', 'g') AS id, observed_at AS ts FROM changes WHERE source_id IS NOT NULL
  UNION ALL
  SELECT 'snapshots', CAST(snapshot_id AS VARCHAR), regexp_replace(lower(source_id), '^\\s+|\\s+$', '', 'g'), fetched_at FROM snapshots WHERE source_id IS NOT NULL),
p AS (SELECT regexp_replace(lower(source_id), '^\\s+|\\s+$', '', 'g') AS id, registered_at AS f, coalesce(retired_at, TIMESTAMP '9999-12-31') AS t FROM sources),
o AS (SELECT DISTINCT ref_table, ref_key, strftime(ts, '%Y-%m') AS ref_month,
    CASE WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.id = refs.id) THEN 'missing'
         WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.id = refs.id AND p.f <= refs.ts) THEN 'late' ELSE 'deleted' END AS reason
  FROM refs WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id = refs.id AND p.f <= refs.ts AND refs.ts < p.t))
"""

ORACLES = {
    "p2_found": _P2 + "SELECT source_id, week_start, change_kind FROM d",
    "p2_weekly_counts": _P2 + "SELECT week_start, change_kind, count(*) AS n_sources FROM d GROUP BY ALL",
    "p2_changed_values": _P2 + "SELECT source_id, week_start, change_kind, old_content_sha256, new_content_sha256, old_chars, new_chars FROM d",
    "p5_found": _P5 + "SELECT ref_table, ref_key, ref_month, reason FROM o",
    "p5_orphans_by_month": _P5 + "SELECT ref_table, ref_month, reason, count(*) AS n_refs FROM o GROUP BY ALL",
}
