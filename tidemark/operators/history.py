"""Snapshots over time: latest, retention, transitions, as-of comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.plans.ordered import previous_row, running_max


def latest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The last row of each key. Pre-aggregated, so a hot key is no burden; null keys form a key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in keep])


def newest_n(df: DataFrame, key: str, order: list[str], n: int, day: Column) -> DataFrame:
    """The newest ``n`` rows of each key, with their rank from 1.

    At least 2, since the last comparison must stay reproducible. Two rounds: the
    newest n per (key, day) first, so that no key's rows meet in one task, then
    the newest n of what is left.
    """
    if n < 2:
        raise ValueError("retention keeps at least two rows a key")
    down = [F.col(c).desc_nulls_last() for c in order]
    near = df.withColumn("__tm_day", day)
    near = near.withColumn("__tm_n", F.row_number().over(Window.partitionBy(key, "__tm_day").orderBy(*down))).filter(F.col("__tm_n") <= n)
    near = near.withColumn("rank_no", F.row_number().over(Window.partitionBy(key).orderBy(*down)).cast("bigint"))
    return near.filter(F.col("rank_no") <= n).drop("__tm_day", "__tm_n")


def transitions(df: DataFrame, key: str, order: list[str], day: Column, value: str) -> DataFrame:
    """Rows whose ``value`` differs from the row before: key, order columns, previous and new value, change_id."""
    near = previous_row(df.select(key, *order, value), [key], order, day, [value])
    moved = near.filter(F.col("prev").isNotNull() & ~F.col(f"prev.{value}").eqNullSafe(F.col(value)))
    return moved.select(key, *order, F.col(f"prev.{value}").alias("previous_hash"), F.col(value).alias("new_hash"), T.change_id(F.col(key), F.col(f"prev.{value}"), F.col(value)).alias("change_id"))


def first_write_wins(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return df.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in keep])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, order: list[str], carry: list[str], day: Column) -> DataFrame:
    """Left rows with ``found``, a struct of ``carry`` from the last right row of the key strictly before ``at``.

    ``right`` is ordered by ``order``, whose first column is ``since``. No row
    before: null. Null times on the left find nothing, on the right are left out.
    ``day`` is an expression over a column ``__tm_at``. Runs as a running maximum
    over the union, split by (key, day): no join explodes, no key is one task's.
    """
    base = left.withColumn("__tm_at", F.col(at)).withColumn("__tm_side", F.lit(0)).withColumn("__tm_row", F.lit(None).cast(_row_type(right, order, carry)))
    rows = right.filter(F.col(since).isNotNull()).select(
        key, F.col(since).alias("__tm_at"), F.lit(1).alias("__tm_side"), F.struct(*order, *[c for c in carry if c not in order]).alias("__tm_row"))
    both = base.unionByName(rows, allowMissingColumns=True)
    run = running_max(both, [key], ["__tm_at", "__tm_side"], day, "__tm_row", "__tm_found")
    out = run.filter(F.col("__tm_side") == 0).withColumn("found", F.when(F.col("__tm_found").isNotNull() & F.col(at).isNotNull(), F.struct(*[F.col(f"__tm_found.{c}").alias(c) for c in carry])))
    return out.drop("__tm_at", "__tm_side", "__tm_row", "__tm_found")


def _row_type(right: DataFrame, order: list[str], carry: list[str]) -> str:
    return right.select(F.struct(*order, *[c for c in carry if c not in order]).alias("r")).schema["r"].dataType.simpleString()


def watch_bucket(ok: Column, outcome: Column, has_previous: Column, same_url: Column, same_contract: Column, rederivable: Column, same_hash: Column) -> Column:
    """One bucket per fetch; the first that holds. A failure is never drift and a first sighting is a baseline."""
    return (
        F.when(~F.coalesce(ok, F.lit(False)), "unreachable")
        .when(outcome == "no-text", "no_text")
        .when(~has_previous, "new")
        .when(~same_url, "rebaselined")
        .when(~same_contract & ~rederivable, "unrenormalizable")
        .when(same_hash & same_contract, "unchanged")
        .when(same_hash, "renormalized")
        .otherwise("changed")
    )
