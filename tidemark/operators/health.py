"""Failure streaks and silence per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import duration_words
from tidemark.plans.ordered import max_so_far


def streaks(attempts: DataFrame) -> DataFrame:
    """Adds streak, streak_started_at, silence_seconds and had_success to measured or failed attempts.

    ``attempts``: source_id, at, seq (unique), outcome in 'measured', 'no-text',
    'not-retrieved'. A failure adds one, a measured fetch resets to 0, 'no-text' does
    neither and is left out. A source's rows are split at its successes: the last
    success before a row is found by a blocked running maximum, the rest runs per
    (source, success).
    """
    rows = attempts.filter(F.col("outcome") != "no-text").withColumn("__tm_ok", F.when(F.col("outcome") == "measured", F.struct("at", "seq")))
    rows = max_so_far(rows, ["source_id"], ["at", "seq"], "__tm_ok", "__tm_last")
    island = Window.partitionBy("source_id", "__tm_last").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    failed = (F.col("outcome") == "not-retrieved").cast("int")
    out = rows.withColumn("streak", F.sum(failed).over(island).cast("bigint"))
    out = out.withColumn("streak_started_at", F.min(F.when(failed == 1, F.col("at"))).over(island)).withColumn("had_success", F.col("__tm_last").isNotNull())
    lasting = F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(F.col("streak_started_at").cast("timestamp"))
    out = out.withColumn("silence_seconds", F.when(F.col("streak") > 0, F.greatest(F.lit(0), lasting)).cast("bigint"))
    return out.drop("__tm_ok", "__tm_last")


def escalations(streaked: DataFrame, threshold: int = 3, silence_days: int = 14) -> DataFrame:
    """Failures at which a source counts as possibly removed: enough failures, enough silence and an earlier success."""
    hit = (F.col("streak") >= threshold) & (F.col("silence_seconds") >= silence_days * 86_400) & F.col("had_success") & (F.col("outcome") == "not-retrieved")
    return streaked.filter(hit).withColumn("silence_words", duration_words(F.col("silence_seconds")))


def health_now(streaked: DataFrame) -> DataFrame:
    """Each source's state after its last attempt."""
    last = F.max_by(F.struct("streak", "streak_started_at", "silence_seconds"), F.struct("at", "seq"))
    out = streaked.groupBy("source_id").agg(
        last.alias("s"), F.max(F.when(F.col("outcome") == "measured", F.col("at"))).alias("last_success_at"), F.max(F.when(F.col("outcome") == "not-retrieved", F.col("at"))).alias("last_failure_at"))
    return out.select("source_id", F.col("s.streak").alias("streak"), F.when(F.col("s.streak") > 0, F.col("s.streak_started_at")).alias("streak_started_at"), F.when(F.col("s.streak") > 0, F.col("s.silence_seconds")).alias("silence_seconds"), "last_success_at", "last_failure_at")


def outages(streaked: DataFrame) -> DataFrame:
    """Outages that ended with a later success: source_id, streak_started_at, n_failures, last_failure_at."""
    failed = F.col("outcome") == "not-retrieved"
    runs = streaked.filter(failed).groupBy("source_id", "streak_started_at").agg(F.max("streak").alias("n_failures"), F.max("at").alias("last_failure_at"))
    last = streaked.filter(~failed).groupBy("source_id").agg(F.max("at").alias("last_success_at"))
    return runs.join(last, "source_id").filter(F.col("last_success_at") > F.col("last_failure_at")).drop("last_success_at")
