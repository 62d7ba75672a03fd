"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.ordered import max_so_far

_END = "9999-12-31 00:00:00"


def folded_key(c: Column) -> Column:
    """Letter case and surrounding white space (any kind) do not count."""
    return F.regexp_replace(F.lower(c), r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$", "")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """References whose parent row does not hold at their time, with the reason.

    ``refs``: ref_table, ref_key, ref_id, ref_at. ``parents``: id, valid_from,
    valid_to (exclusive, null = open). Output: ref_table, ref_key, ref_month,
    reason, distinct.

    reason: 'missing' - no parent row of that id; 'late' - all rows of the id begin
    after the time; 'deleted' otherwise. A null reference is no reference. A null
    reference time with a known id cannot be placed and is left out; with an
    unknown id it is 'missing' with a null month. A parent row with null
    valid_from is taken to have held from the start.

    Plan: distinct foreign keys are pre-aggregated and anti-joined against the
    distinct parent keys, then joined back. For the known keys the running maximum
    of valid_to over the rows begun so far tells whether one still holds; it runs
    over blocks of a range partitioning, so no id is ever one task's work.
    """
    r = refs.filter(F.col("ref_id").isNotNull()).withColumn("id", folded_key(F.col("ref_id"))).select("ref_table", "ref_key", "id", "ref_at")
    p = parents.filter(F.col("id").isNotNull()).select(
        folded_key(F.col("id")).alias("id"),
        F.coalesce(F.col("valid_from").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("valid_from"),
        F.coalesce(F.col("valid_to").cast("timestamp_ntz"), F.lit(_END).cast("timestamp_ntz")).alias("valid_to"),
    )
    missing = r.select("id").distinct().join(p.select("id").distinct(), "id", "left_anti")
    absent = r.join(missing, "id", "left_semi").withColumn("reason", F.lit("missing"))
    known = r.filter(F.col("ref_at").isNotNull()).join(missing, "id", "left_anti")
    both = known.select(
        "id", F.col("ref_at").cast("timestamp_ntz").alias("at"), F.lit(1).alias("kind"), "ref_table", "ref_key", F.lit(None).cast("timestamp_ntz").alias("valid_to"),
    ).unionByName(
        p.select("id", F.col("valid_from").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("ref_key"), "valid_to")
    )
    held = max_so_far(both, ["id"], ["at", "kind", "ref_table", "ref_key"], "valid_to", "held_until")
    judged = held.filter((F.col("kind") == 1) & (F.col("held_until").isNull() | (F.col("held_until") <= F.col("at"))))
    gone = judged.select("ref_table", "ref_key", "id", F.col("at").alias("ref_at"), F.when(F.col("held_until").isNull(), "late").otherwise("deleted").alias("reason"))
    out = absent.select("ref_table", "ref_key", "id", F.col("ref_at").cast("timestamp_ntz").alias("ref_at"), "reason").unionByName(gone)
    return out.select("ref_table", F.col("ref_key").cast("string").alias("ref_key"), F.date_format("ref_at", "yyyy-MM").alias("ref_month"), "reason").distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period and reason."""
    return orphans.groupBy("ref_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_refs"))
