from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming.streaks import latest_states, streak_stream, weekly_availability

SCHEMA = "source_id string, at timestamp, seq string, outcome string"
T0 = datetime(2026, 1, 5)


def replay(spark, tmp_path, batches, plan, mode):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    run = plan(stream).writeStream.outputMode(mode).foreachBatch(lambda b, i: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


def test_streaks_over_batches_and_replays(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    first = [("a", at(0), "1", "measured"), ("a", at(2), "3", "not-retrieved"), ("a", at(1), "2", "not-retrieved"), ("b", at(0), "1", "not-retrieved"), (None, at(0), "1", "measured")]
    second = [*first, ("a", at(3), "4", "no-text"), ("a", at(4), "5", "not-retrieved"), ("b", at(5), "2", "measured")]
    got = {x.source_id: (x.streak, x.streak_started_at) for x in latest_states(replay(spark, tmp_path, [first, second], streak_stream, "update")).collect()}
    assert got == {"a": (3, at(1)), "b": (0, None)}


def test_weekly_availability(spark, tmp_path):
    rows = [("a", T0 + timedelta(days=d), str(d), "measured" if d % 2 else "not-retrieved") for d in range(60)]
    got = replay(spark, tmp_path, [rows, [("a", T0 + timedelta(days=200), "x", "measured")]], weekly_availability, "append")
    weeks = {x.start: (x.n, x.available) for x in got.select("window.start", "n", "available").collect()}
    assert weeks[T0][0] == 7 and abs(weeks[T0][1] - 3 / 7) < 1e-9
    assert all(s.weekday() == 0 for s in weeks)
    assert got.agg(F.sum("n")).first()[0] == 60
