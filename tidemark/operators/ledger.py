"""The ledger of changes: decisions, lifecycle, replacements, and the runs that bind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.runs import receipts


def events(changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Observations, first decisions, second decisions and lifecycle events of change rows; repeated rows count once, stages without a time did not happen."""
    first = changes.filter(F.col("reviewed_at").isNotNull()).select("change_id", "significance", "reviewer", "reviewed_at").distinct()
    second = changes.filter(F.col("independent_reviewed_at").isNotNull()).select("change_id", "independent_review_status", "independent_reviewer", "independent_reviewed_at").distinct()
    life = changes.filter(F.col("lifecycle_at").isNotNull()).select("change_id", "publication_status", "superseded_by", "lifecycle_at").distinct()
    return changes.select("change_id", "kind").distinct(), first, second, life


def change_state(observed: DataFrame, first: DataFrame, second: DataFrame, life: DataFrame) -> DataFrame:
    """Current state per observation: its events joined on, with the defaults of what has not happened. Null ids match nothing."""
    j = observed.join(first, "change_id", "left").join(second, "change_id", "left").join(life, "change_id", "left")
    return j.select(
        "change_id", "kind", F.coalesce("significance", F.lit("unclassified")).alias("significance"), "reviewer", F.coalesce("independent_review_status", F.lit("none")).alias("second_status"),
        F.col("independent_reviewer").alias("second_reviewer"), F.coalesce("publication_status", F.lit("active")).alias("publication_status"), "superseded_by")


def decision_counts(changes: DataFrame) -> DataFrame:
    """Per stage: decisions, changes decided, decisions beyond a change's first, unsigned ones."""
    stages = [("first", "reviewer", "reviewed_at"), ("second", "independent_reviewer", "independent_reviewed_at"), ("lifecycle", "lifecycle_actor", "lifecycle_at")]
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(a).alias("actor"), F.col(t).alias("at")) for n, a, t in stages])
    each = changes.select("change_id", F.explode(rows).alias("e")).select("change_id", "e.*").filter(F.col("at").isNotNull()).distinct()
    own = each.groupBy("stage", "change_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("actor"), F.lit("")) == "").alias("unsigned"))
    return own.groupBy("stage").agg(F.sum("n").alias("n_decisions"), F.count("change_id").alias("n_changes"), (F.sum("n") - F.count("change_id")).alias("n_repeated"), F.sum("unsigned").alias("n_unsigned"))


def replacement_checks(changes: DataFrame) -> DataFrame:
    """Self join of corrections with what replaces them: present, same_subject, in_time (observed not before the last decision)."""
    subject = ["source_id", "jurisdiction", "document_class", "url"]
    c = changes.select("change_id", *subject, "superseded_by", "observed_at", F.coalesce("independent_reviewed_at", "reviewed_at").alias("ready_at")).distinct()
    old = c.filter(F.coalesce("superseded_by", F.lit("")) != "")
    new = c.select(F.col("change_id").alias("superseded_by"), F.struct(*subject, "observed_at").alias("r"))
    same = F.col("r").isNotNull()
    for s in subject:
        same = same & F.col(s).eqNullSafe(F.col(f"r.{s}"))
    return old.join(new, "superseded_by", "left").select("change_id", "superseded_by", F.col("r").isNotNull().alias("present"), same.alias("same_subject"), F.coalesce(F.col("r.observed_at") >= F.col("ready_at"), F.lit(False)).alias("in_time"))


def vocabulary_counts(df: DataFrame, vocabulary: dict[str, list[str]], key: str) -> DataFrame:
    """column_name, value, n, known: values of closed columns over distinct (key, value); null is in no vocabulary."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.coalesce(F.col(c).isin(v), F.lit(False)).alias("known")) for c, v in vocabulary.items()])
    each = df.select(key, F.explode(rows).alias("e")).select(key, "e.*").distinct()
    return each.groupBy("column_name", "value", "known").agg(F.count(F.lit(1)).alias("n")).select("column_name", "value", "n", "known")


def run_source_sets(attempts: DataFrame) -> DataFrame:
    """Sources of each run by outcome, sorted and joined by commas, null where there are none. A run's set is bounded by the registry."""
    ok, blank = F.coalesce("ok", F.lit(False)), F.coalesce(F.col("extraction_outcome") == "no-text", F.lit(False))
    kinds = {"attempted": F.lit(True), "successful": ok, "unmeasured": ok & blank, "observed": ok & ~blank}
    sets = {n: F.array_sort(F.collect_set(F.when(k, F.col("source_id")))) for n, k in kinds.items()}
    got = attempts.filter(F.col("source_id").isNotNull()).groupBy("run_id").agg(*[s.alias(n) for n, s in sets.items()])
    return got.select("run_id", *[F.when(F.size(n) > 0, F.array_join(n, ",")).alias(n) for n in kinds])


def attempts_in_runs(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per run: attempts, and those before its start, after its end, or of a run not ended. Counted per run first, so a run of any size is pre-aggregated."""
    a = attempts.select("run_id", "attempted_at")
    both = runs.join(a, "run_id", "left")
    at = F.col("attempted_at")
    return both.groupBy("run_id").agg(
        F.count("attempted_at").alias("n_attempts"), F.count_if(at < F.col("started_at")).alias("n_early"), F.count_if(at > F.col("completed_at")).alias("n_late"), F.count_if(at.isNotNull() & F.col("completed_at").isNull()).alias("n_running"))


def receipt_agreement(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per state the number of runs and of those whose recorded counters equal the counted ones."""
    j = runs.join(receipts(attempts), "run_id", "left")
    same = [F.count_if(F.col(f"{n}_count") == F.coalesce(n, F.lit(0))).alias(f"{n}_same") for n in ("attempted", "successful", "unmeasured")]
    return j.groupBy("state").agg(F.count(F.lit(1)).alias("n_runs"), *same)
