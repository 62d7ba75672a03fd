"""Chains of records that replace one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable


def chain_ends(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Follows each record's replacements to the end: id, end_id, steps, cyclic.

    ``edges``: id, next_id; one row per id, null next_id is no edge; ids that only
    occur as next_id are ends. Pointers are doubled each round, so a chain of n
    records takes log n joins; records still moving when no chain can be that long
    are on or lead into a cycle (end_id null, steps -1).
    """
    hops = durable(edges.filter(F.col("next_id").isNotNull()).groupBy("id").agg(F.min("next_id").alias("end_id")).withColumn("steps", F.lit(1).cast("bigint")))
    total = hops.count()
    for _ in range(max_rounds):
        ahead = hops.select(F.col("id").alias("end_id"), F.col("end_id").alias("far"), F.col("steps").alias("more"))
        hops = durable(hops.join(ahead, "end_id", "left").select("id", F.coalesce("far", "end_id").alias("end_id"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("far").isNotNull().alias("moved")))
        state = hops.agg(F.coalesce(F.max(F.col("moved").cast("int")), F.lit(0)).alias("moved"), F.min(F.when(F.col("moved"), F.col("steps"))).alias("least")).first()
        hops = hops.drop("moved")
        if not state["moved"] or state["least"] > total:
            break
    cyclic = F.col("steps") > total
    return hops.select("id", F.when(~cyclic, F.col("end_id")).alias("end_id"), F.when(cyclic, F.lit(-1)).otherwise(F.col("steps")).cast("bigint").alias("steps"), cyclic.alias("cyclic"))
