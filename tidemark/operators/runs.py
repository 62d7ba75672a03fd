"""Run receipts and their integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def receipts(attempts: DataFrame) -> DataFrame:
    """Per run what its attempts say: attempted, successful, unmeasured, observed, completeness."""
    got = attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("ok")).alias("successful"),
        F.count_if(F.col("ok") & (F.col("extraction_outcome") == "no-text")).alias("unmeasured"))
    return got.withColumn("observed", F.col("successful") - F.col("unmeasured"))


def receipt_faults(runs: DataFrame, got: DataFrame) -> DataFrame:
    """Ended runs whose counters differ from their attempts: run_id, counter, recorded, counted."""
    ended = runs.filter(F.col("state") != "running")
    both = ended.join(got, "run_id", "left")
    pairs = F.array(*[
        F.struct(F.lit(name).alias("counter"), F.col(name).cast("bigint").alias("recorded"), F.coalesce(F.col(own), F.lit(0)).cast("bigint").alias("counted"))
        for name, own in (("attempted_count", "attempted"), ("successful_count", "successful"), ("unmeasured_count", "unmeasured"))])
    return both.select("run_id", F.explode(pairs).alias("p")).select("run_id", "p.*").filter(~F.col("recorded").eqNullSafe(F.col("counted")))


def derived_state(eligible: Column, unreachable: Column, unmeasured: Column, observations: Column) -> Column:
    """Nothing to do fails; anything unreachable or unmeasured is partial; else complete with observations, quiet without."""
    return F.when(eligible == 0, "failed").when((unreachable + unmeasured) > 0, "partial").when(observations > 0, "complete").otherwise("quiet")


def latest_run(runs: DataFrame, aggregate_only: bool = True) -> DataFrame:
    """The last successful run by (started_at, run_id)."""
    good = runs.filter(F.col("state").isin("quiet", "complete"))
    good = good.filter(F.col("jurisdiction").isNull()) if aggregate_only else good
    return good.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(1)
