"""Differences between full deliveries of a table.

Method: compact key and row hashes are spread over hash buckets, each bucket is
sorted in numpy and compared with ``searchsorted`` set differences, and full
values are fetched only for the keys that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMPACT = "bucket int, delivery int, k1 bigint, k2 bigint, r1 bigint, r2 bigint"
_DIFF = "delivery int, k1 bigint, k2 bigint, change_kind string"


def last_of_delivery(df: DataFrame, key: str, delivery: str, order: list[str], value: str) -> DataFrame:
    """One compact row per (key, delivery): its last record's ``order`` columns and two row hashes of ``value``.

    Null keys and deliveries are left out. Values are hashed at the scan and the
    maximum is pre-aggregated before the shuffle, so no value travels and a hot
    key costs one row per map task. A null value has a hash of its own.
    """
    text = F.coalesce(F.concat(F.lit("v"), F.col(value)), F.lit("n"))
    last = F.max(F.struct(*order, F.xxhash64(F.lit("a"), text).alias("r1"), F.xxhash64(F.lit("b"), text).alias("r2")))
    return (
        df.filter(F.col(key).isNotNull() & F.col(delivery).isNotNull())
        .groupBy(key, delivery)
        .agg(last.alias("__last"))
        .select(
            key, F.col(delivery).cast("int").alias(delivery), *[F.col(f"__last.{c}").alias(c) for c in (*order, "r1", "r2")],
            F.xxhash64(F.lit("a"), key).alias("k1"), F.xxhash64(F.lit("b"), key).alias("k2"),
        )
    )


def _bucket_diff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Deliveries of one task's buckets, compared pairwise in delivery order.

    Rows arrive sorted by (bucket, delivery); a bucket is handled when its last
    row has been seen, so memory holds one bucket, whose size the caller bounds.
    """

    def flush(parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        a = np.concatenate(parts)
        for d in np.unique(np.concatenate([a["delivery"], a["delivery"] + 1])):
            new, old = a[a["delivery"] == d], a[a["delivery"] == d - 1]
            new, old = np.sort(new, order=["k1", "k2"]), np.sort(old, order=["k1", "k2"])
            kn, ko = _joined(new), _joined(old)
            at = np.searchsorted(ko, kn)
            hit = np.zeros(len(kn), bool)
            if len(ko):
                near = np.minimum(at, len(ko) - 1)
                hit = ko[near] == kn
                moved = hit & ((old["r1"][near] != new["r1"]) | (old["r2"][near] != new["r2"]))
            else:
                moved = hit
            back = np.searchsorted(kn, ko)
            gone = np.ones(len(ko), bool)
            if len(kn):
                gone = kn[np.minimum(back, len(kn) - 1)] != ko
            for rows, kind in ((new[~hit], "added"), (new[moved], "changed"), (old[gone], "removed")):
                if len(rows):
                    yield pd.DataFrame({"delivery": np.int32(d), "k1": rows["k1"], "k2": rows["k2"], "change_kind": kind})

    parts: list[np.ndarray] = []
    current = None
    kinds = np.dtype([("delivery", "i4"), ("k1", "i8"), ("k2", "i8"), ("r1", "i8"), ("r2", "i8")])
    for f in frames:
        b = f["bucket"].to_numpy()
        for lo, hi in _runs(b):
            if current is not None and b[lo] != current:
                yield from flush(parts)
                parts = []
            current = b[lo]
            rows = np.empty(hi - lo, kinds)
            for c in kinds.names:
                rows[c] = f[c].to_numpy()[lo:hi]
            parts.append(rows)
    if parts:
        yield from flush(parts)


def _joined(a: np.ndarray) -> np.ndarray:
    """128-bit keys as sortable records."""
    out = np.empty(len(a), [("k1", "i8"), ("k2", "i8")])
    out["k1"], out["k2"] = a["k1"], a["k2"]
    return out


def _runs(b: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(b)) + 1
    cuts = [0, *edges.tolist(), len(b)]
    return [(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def snapshot_deltas(df: DataFrame, key: str, delivery: str, order: list[str], value: str, extra: list[str] | None = None, rows_per_bucket: int = 200_000) -> DataFrame:
    """Added, removed and changed keys between successive integer deliveries.

    ``delivery`` is an int column whose successive values are successive
    deliveries. Output: key, delivery (the later one), change_kind, old and new
    ``value`` and ``extra`` columns (null on the absent side). 'changed' means
    ``value`` differs, nulls equal nulls. The first delivery gives no rows, nor does
    the one after the last. A delivery that is absent between others counts as empty.

    Hash equality is 128 bits wide for keys and rows. ``rows_per_bucket`` bounds
    a task's bucket; the number of buckets grows with the table.
    """
    extra = extra or []
    last = last_of_delivery(df, key, delivery, order, value)
    span = df.filter(F.col(key).isNotNull()).agg(F.min(delivery).alias("lo"), F.max(delivery).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-span["n"] // rows_per_bucket))
    compact = last.select(F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket"), F.col(delivery).alias("delivery"), "k1", "k2", "r1", "r2")
    diff = compact.repartition(F.col("bucket")).sortWithinPartitions("bucket", "delivery").mapInPandas(_bucket_diff, _DIFF)
    if span["lo"] is None:
        diff = diff.filter(F.lit(False))
    else:
        diff = diff.filter((F.col("delivery") > span["lo"]) & (F.col("delivery") <= span["hi"]))
    # the records of the differing keys, on the side or sides where they exist, then their full values
    sides = F.when(F.col("change_kind") == "added", F.array(F.lit(0))).when(F.col("change_kind") == "removed", F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    wanted = diff.withColumn("back", F.explode(sides)).withColumn(delivery, F.col("delivery") - F.col("back")).drop("delivery")
    rows = wanted.join(last.drop("r1", "r2"), ["k1", "k2", delivery])
    cells = [value, *extra]
    full = rows.join(df.select(key, *order, *cells), [key, *order])
    named = full.select(
        F.col(key), (F.col(delivery) + F.col("back")).alias(delivery), "change_kind",
        *[F.when(F.col("back") == 1, F.col(c)).alias(f"old_{c}") for c in cells],
        *[F.when(F.col("back") == 0, F.col(c)).alias(f"new_{c}") for c in cells],
    )
    return named.groupBy(key, delivery, "change_kind").agg(*[F.max(f"{s}_{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in cells])


def delivery_counts(deltas: DataFrame, delivery: str) -> DataFrame:
    """Rows per delivery and kind of change."""
    return deltas.groupBy(delivery, "change_kind").agg(F.count(F.lit(1)).alias("n_sources"))
