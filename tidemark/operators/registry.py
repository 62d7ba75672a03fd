"""The registry as a table: rules, duplicates, totals, completeness, revision."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strict_date, url_faults

SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def entry_faults() -> Column:
    """Names of the rules an entry breaks, in a fixed order."""
    v, p = F.col("verification"), F.col("fetch_policy")
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("source_id").rlike(SLUG), F.lit(False)), "id-shape"),
        F.when(F.trim(F.coalesce(F.col("authority"), F.lit(""))) == "", "no-authority"),
        F.when(F.col("verified") != (v["status"] == "verified"), "verified-differs"),
        F.when((v["status"] != "unverified") & ((F.trim(v["verifier"]) == "") | strict_date(v["at"]).isNull()), "verification-unsigned"),
        F.when((v["expires_at"] != "") & strict_date(v["expires_at"]).isNull(), "expiry-shape"),
        F.when(strict_date(v["expires_at"]) < strict_date(v["at"]), "expiry-before-decision"),
        F.when(p["outcome"].isin("allow", "deny") & (F.trim(F.coalesce(p["reviewer"], F.lit(""))) == ""), "policy-unsigned"),
    ))
    return F.concat(faults, url_faults(F.col("url")))


def fault_counts(df: DataFrame, faults: str) -> DataFrame:
    """Rows per fault; a row with several counts for each."""
    return df.select(F.explode(faults).alias("fault")).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values on more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def holding_at(df: DataFrame, at: Column) -> DataFrame:
    """Rows that hold at a time: from registered_at, inclusive, to retired_at, exclusive."""
    return df.filter((F.col("registered_at") <= at) & (F.col("retired_at").isNull() | (F.col("retired_at") > at)))


def verification_summary(df: DataFrame) -> DataFrame:
    """Per jurisdiction and over all (null) in one pass."""
    s = F.col("verification.status")
    return df.groupingSets([["jurisdiction"], []], "jurisdiction").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "verified").alias("verified"), F.count_if(s == "unverified").alias("unverified"), F.count_if(s == "rejected").alias("rejected"))


def missing_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of the vocabularies of ``a`` and ``b`` that no row has.

    The vocabularies are closed lists of some dozens of values; the product is
    built from their distinct values, never from rows.
    """
    have = df.select(a, b).distinct()
    values = df.agg(F.array_sort(F.collect_set(b)).alias("all"))
    grid = df.select(a).filter(F.col(a).isNotNull()).distinct().join(F.broadcast(values)).select(a, F.explode("all").alias(b))
    return grid.join(have, [a, b], "left_anti")


def completeness_faults(held: DataFrame, every: DataFrame, gaps: DataFrame) -> DataFrame:
    """jurisdiction, document_class, fault: 'silent' pairs that are missing and not named as gaps, 'stale' ones named and not missing.

    The vocabularies are those of ``every``; ``held`` are the entries that count, ``gaps`` the named pairs.
    """
    pair = ["jurisdiction", "document_class"]
    have = held.select(*pair).distinct()
    values = every.agg(F.array_sort(F.collect_set("document_class")).alias("all"))
    grid = every.select("jurisdiction").filter(F.col("jurisdiction").isNotNull()).distinct().join(F.broadcast(values)).select("jurisdiction", F.explode("all").alias("document_class"))
    missing, named = grid.join(have, pair, "left_anti"), gaps.select(*pair).distinct()
    silent = missing.join(named, pair, "left_anti").withColumn("fault", F.lit("silent"))
    return silent.unionByName(named.join(missing, pair, "left_anti").withColumn("fault", F.lit("stale")))


def in_scope(df: DataFrame, jurisdiction: str) -> DataFrame:
    """Entries of one jurisdiction, in any letter case. Raises where no entry has it: an unknown scope is an error, not an empty answer."""
    own = df.filter(F.upper("jurisdiction") == jurisdiction.strip().upper())
    if own.isEmpty():
        raise ValueError(f"no entries of jurisdiction {jurisdiction!r}")
    return own


def revision(entries: list[dict]) -> str:
    """Digest of entries in their order: canonical JSON, keys sorted, compact, UTF-8. Registries are small files."""
    return hashlib.sha256(json.dumps(entries, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
