"""Streams give the rows of their batch forms."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import runs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture()
def replay(spark, tmp_path):
    """The events in three files, oldest first, as a stream."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    for hour, file in enumerate(sorted((tmp_path / "in").glob("part-*"))):
        os.utime(file, (hour * 3600, hour * 3600))  # a stream takes files by age
    return lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert not query.exception()
    return stream.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_sessions_and_windows(spark, replay, tmp_path):
    batch = runs.stamped(spark.read.parquet(f"{FOLDER}/events.parquet"))
    end = batch.agg(F.max("at")).first()[0]
    for name, make in (("sessions", lambda e, late=None: runs.idle_sessions(e, "6 hours", late)),
                       ("windows", lambda e, late=None: runs.outcome_counts(e, "6 hours", "3 hours", late))):
        got = rows(run(make(runs.stamped(replay()), "1 hour"), name, tmp_path))
        want = rows(make(batch))
        # what the watermark has passed is final; nothing else has been put out
        assert got and set(got) <= set(want) and end is not None


def test_budget(spark, replay, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("size", F.length("props"))
    got = rows(run(runs.stream_budget(replay().withColumn("size", F.length("props")), "size", 60), "budget", tmp_path))
    assert got == rows(runs.byte_budget(events, F.col("size"), 60).select("user_id", "event_id", "used"))


def plain_runs(times, idle, wall):
    """Runs of sorted times in microseconds, event by event."""
    out = []
    for t in times:
        if out and t < min(out[-1][0] + wall, out[-1][1] + idle):
            out[-1][1:] = [t, out[-1][2] + 1]
        else:
            out.append([t, t, 1])
    return [(a, min(a + wall, b + idle), n, "wall" if a + wall <= b + idle else "idle") for a, b, n in out]


def micros(df):
    return sorted((str(r.user_id), r.a, r.b, r.events, r.reason) for r in df.select(
        "user_id", F.unix_micros("started").alias("a"), F.unix_micros("ended").alias("b"), "events", "reason").collect())


@pytest.mark.parametrize("width", ["30 days", "3 seconds"])
def test_wall_runs(spark, width):
    rng = random.Random(3)
    times = {u: sorted(rng.randrange(40) for _ in range(rng.choice([1, 5, 60]))) for u in (None, 1, 2, 3, 4)}
    times[5] = list(range(200))  # a long chain: one run after the other
    rows = [(u, i, datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=t)) for u, ts in times.items() for i, t in enumerate(ts)]
    events = spark.createDataFrame([*rows, (1, 99, None)], "user_id long, event_id long, at timestamp").repartition(3)
    base = int(datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC).timestamp()) * 1_000_000
    want = sorted((str(u), base + a, base + b, n, why) for u, ts in times.items() for a, b, n, why in plain_runs([t * 1_000_000 for t in ts], 4_000_000, 7_000_000))
    assert micros(runs.wall_runs(events, "4 seconds", "7 seconds", width)) == want
    assert {w[4] for w in want} == {"idle", "wall"}
    assert runs.wall_runs(events.limit(0), "4 seconds", "7 seconds").count() == 0


def test_wall_runs_stream(spark, replay, tmp_path):
    events = runs.stamped(spark.read.parquet(f"{FOLDER}/events.parquet"))
    got = micros(run(runs.stream_wall_runs(runs.stamped(replay()), "24 hours", "30 hours", "1 hour"), "walls", tmp_path))
    want = micros(runs.wall_runs(events, "24 hours", "30 hours"))
    third = events.select(F.unix_micros("at").alias("t")).orderBy("t").collect()
    passed = third[len(third) // 2]["t"] - 3_600_000_000  # the watermark after two of three files lies beyond
    assert set(got) <= set(want) and len(set(got)) == len(got)
    assert {w for w in want if w[2] < passed} <= set(got) and {w[4] for w in got} == {"idle", "wall"}


def test_orphans_stream(spark, tmp_path):
    day = lambda s: datetime.datetime(2020, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    files = [[("s", "a", None, day(0)), ("s", "b", "a", day(5)), ("s", "c", "x", day(6)), ("s", "b", "a", day(5)), ("t", "d", "a", day(7))],
             [("s", "late", "after", day(30)), ("s", "after", None, day(31)), ("s", "e", "c", day(32))], [("z", "end", None, day(500))], [("z", "end2", None, day(900))]]
    shape = "scope string, id string, parent string, at timestamp"
    for i, part in enumerate(files):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        for file in (tmp_path / "in" / f"{i}").glob("part-*"):
            os.utime(file, (i * 3600, i * 3600))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = run(runs.stream_orphans(stream, "10 seconds", "60 seconds"), "orphans", tmp_path)
    assert sorted((r.scope, r.id) for r in got.collect()) == [("s", "c"), ("s", "late"), ("t", "d")]
