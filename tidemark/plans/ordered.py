"""Neighbour and running-maximum plans that no hot key can overload.

A window partitioned by a key puts the whole key into one task. Here each key is
cut into blocks (a day, say), the window runs per (key, block), and only the rows
at block edges are stitched by a second, small window per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

_EDGE, _PREV, _BLOCK = "__tm_edge", "__tm_prev", "__tm_block"


def previous_row(df: DataFrame, key: Sequence[str], order: Sequence[str], block: Column, carry: Sequence[str]) -> DataFrame:
    """Adds ``prev``, a struct of ``carry`` from the row before in (key, order), null at a key's first row.

    ``block`` must not decrease along ``order``. Null keys form a group of their
    own; null order values come first. Rows equal in all of ``order`` are ordered
    arbitrarily, so end ``order`` with a unique column. An empty table gives an
    empty result. Existing columns named ``prev`` are replaced.
    """
    named = F.struct(*[F.col(c) for c in carry])
    by = [F.col(c).asc_nulls_first() for c in order]
    inner = Window.partitionBy(*key, _BLOCK).orderBy(*by)
    cut = (
        df.drop("prev")
        .withColumn(_BLOCK, block)
        .withColumn(_PREV, F.lag(named).over(inner))
        .withColumn(_EDGE, F.lag(F.lit(1)).over(inner).isNull() | F.lead(F.lit(1)).over(inner).isNull())
    )
    # both branches read the same shuffle (exchange reuse), the second keeps edge rows only
    inside = cut.filter(~F.col(_EDGE)).withColumn("prev", F.col(_PREV))
    outer = Window.partitionBy(*key).orderBy(F.col(_BLOCK).asc_nulls_first(), *by)
    edges = cut.filter(F.col(_EDGE)).withColumn("prev", F.coalesce(F.col(_PREV), F.lag(named).over(outer)))
    return inside.unionByName(edges).drop(_EDGE, _PREV, _BLOCK)


def running_max(df: DataFrame, key: Sequence[str], order: Sequence[str], block: Column, value: str, out: str) -> DataFrame:
    """Adds ``out``: the largest ``value`` of the key's rows up to and including this one in ``order``.

    Nulls in ``value`` are passed over. Blocks as in :func:`previous_row`; ties in
    ``order`` see only the rows placed before them, so end it with a tie-break.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    inner = Window.partitionBy(*key, _BLOCK).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    based = df.withColumn(_BLOCK, block)
    # per block one row: the maximum of all blocks before it
    tops = based.groupBy(*key, _BLOCK).agg(F.max(value).alias(_PREV))
    before = Window.partitionBy(*key).orderBy(F.col(_BLOCK).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn(_PREV, F.max(_PREV).over(before)).filter(F.col(_PREV).isNotNull())
    keys = [*key, _BLOCK]
    tops = tops.select(*[F.col(k).alias(f"__tm_k{i}") for i, k in enumerate(keys)], _PREV)
    on = _all([F.col(k).eqNullSafe(F.col(f"__tm_k{i}")) for i, k in enumerate(keys)])
    joined = based.join(tops, on, "left").select(*based.columns, _PREV)
    return joined.withColumn(out, F.greatest(F.max(value).over(inner), F.col(_PREV))).drop(_BLOCK, _PREV)


def _all(conditions: list[Column]) -> Column:
    total = conditions[0]
    for c in conditions[1:]:
        total = total & c
    return total


def positions(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Adds ``out``: each row's place, from 1, in the order of the whole table.

    No task sees the whole table: rows are range-partitioned, numbered within their
    partition, and shifted by the sizes of the partitions before. End ``order``
    with a unique column; ties are placed arbitrarily.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).withColumn(_BLOCK, F.spark_partition_id()))
    sizes = ranged.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias(_PREV))
    before = sizes.withColumn(_PREV, F.coalesce(F.sum(_PREV).over(Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row per partition
    numbered = ranged.withColumn(out, F.row_number().over(Window.partitionBy(_BLOCK).orderBy(*order)))
    return numbered.join(F.broadcast(before), _BLOCK).withColumn(out, (F.col(out) + F.col(_PREV)).cast("bigint")).drop(_BLOCK, _PREV)


def range_blocks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``__tm_range``, a block number that never falls along ``columns``, for use as ``block`` above.

    The blocks are the partitions of a range partitioning, written down so that
    every later read sees the same; a key of any size is cut into several.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in columns]).withColumn("__tm_range", F.spark_partition_id()))


def previous_in_order(df: DataFrame, key: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """:func:`previous_row` over range blocks, for keys that may hold any number of rows of any one time."""
    return previous_row(range_blocks(df, [*key, *order]), key, order, F.col("__tm_range"), carry).drop("__tm_range")


def max_so_far(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """:func:`running_max` over range blocks."""
    return running_max(range_blocks(df, [*key, *order]), key, order, F.col("__tm_range"), value, out).drop("__tm_range")
