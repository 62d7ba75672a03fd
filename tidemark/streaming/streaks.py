"""Streaming forms: streak state per source, an idempotent sink, weekly availability."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "streak bigint, started_at timestamp, last_at timestamp, last_seq string"
OUT = "source_id string, streak bigint, streak_started_at timestamp, last_at timestamp, last_seq string"


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    streak, started, last_at, last_seq = state.get if state.exists else (0, None, None, None)
    rows = pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable")
    for at, seq, outcome in zip(rows["at"], rows["seq"], rows["outcome"]):
        if last_at is not None and (at, seq) <= (pd.Timestamp(last_at), last_seq):
            continue  # seen already, or too late to change the state
        if outcome == "not-retrieved":
            streak, started = streak + 1, started if streak else at
        elif outcome == "measured":
            streak, started = 0, None
        last_at, last_seq = at, seq
    state.update((int(streak), started, last_at, last_seq))
    yield pd.DataFrame({"source_id": [key[0]], "streak": [int(streak)], "streak_started_at": [started], "last_at": [last_at], "last_seq": [last_seq]})


def streak_stream(attempts: DataFrame) -> DataFrame:
    """State updates of the streaks of a stream of attempts (source_id, at timestamp, seq string, outcome).

    A failure adds one, a measured fetch resets, 'no-text' changes nothing. Rows not
    after a source's last row are passed over, so replays do no harm; within one
    trigger rows are put in order.
    """
    return attempts.filter(F.col("source_id").isNotNull()).groupBy("source_id").applyInPandasWithState(_fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def latest_states(updates: DataFrame) -> DataFrame:
    """The last update of each source."""
    return updates.groupBy("source_id").agg(F.max_by(F.struct("streak", "streak_started_at"), F.struct("last_at", "last_seq", "streak")).alias("s")).select("source_id", "s.streak", "s.streak_started_at")


def append_new(batch: DataFrame, batch_id: int, path: str, key: str) -> None:
    """First write wins: appends the batch's keys that the table at ``path`` has not; for foreachBatch."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)


def weekly_availability(attempts: DataFrame, late: str = "14 days") -> DataFrame:
    """Share of fetches that succeeded per week; rows later than ``late`` behind the newest are dropped."""
    timed = attempts.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "7 days", startTime="4 days")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("outcome") != "not-retrieved").cast("int")).alias("available"))
