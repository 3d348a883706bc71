"""Run events: sessions, deadlines, budgets and counts, each as a batch plan and as a stream.

Events are ``user_id, ts, event_type, value, event_id``; ``ts`` carries no zone and is read as UTC.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.constants import LEVELS
from quire.operators.scan import asof, running
from quire.session import ensure_checkpoint_dir


def stamped(events: DataFrame) -> DataFrame:
    """Events with ``at``, a timestamp that watermarks accept."""
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def idle_sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events that no pause of ``gap`` interrupts. The same plan serves batch and
    stream; a stream also names how ``late`` events may come."""
    source = events.withWatermark("at", late) if late else events
    return source.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events")).select(
        "user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def deadlines(sessions: DataFrame, gap: str, wall: str) -> DataFrame:
    """Whether the events of each idle session span more than a wall time; nothing ends at it, see ``wall_runs``."""
    last = F.col("ended") - F.expr(f"interval {gap}")
    return sessions.withColumn("reason", F.when(last - F.col("started") > F.expr(f"interval {wall}"), "wall").otherwise("idle"))


def byte_budget(events: DataFrame, size: Column, most: int) -> DataFrame:
    """Batch form: each user's first event at which the running size exceeds the budget."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("used", F.sum(size).over(order)).where(F.col("used") > most).groupBy("user_id").agg(
        F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("used").alias("used"))


def stream_budget(events: DataFrame, size: str, most: int) -> DataFrame:
    """Stream form: one row per user, when its running size first exceeds the budget. The state is
    one sum and one flag per user."""

    def watch(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, told = state.get if state.exists else (0, False)
        for part in rows:
            part = part.sort_values(["ts", "event_id"])
            for event_id, amount in zip(part["event_id"], part[size]):
                used += int(amount)
                if used > most and not told:
                    told = True
                    yield pd.DataFrame({"user_id": [key[0]], "event_id": [event_id], "used": [used]})
        state.update((used, told))

    return events.groupBy("user_id").applyInPandasWithState(
        watch, "user_id long, event_id long, used long", "used long, told boolean", "append", "NoTimeout")


def at_least(events: DataFrame, level: Column, least: str) -> DataFrame:
    """Events of a severity or above; unknown levels are no events of any severity."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), level)
    return events.withColumn("rank", rank).where(F.col("rank") >= LEVELS.index(least) + 1)


def contract_breaks(events: DataFrame) -> DataFrame:
    """Events out of sequence: an id at or below one the user has had at an earlier time."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("highest", F.max("event_id").over(before)).where(F.col("event_id") <= F.col("highest"))


def outcome_counts(events: DataFrame, width: str, slide: str, late: str | None = None) -> DataFrame:
    """Events and their total per type in sliding windows; one plan for batch and stream."""
    source = events.withWatermark("at", late) if late else events
    return source.groupBy(F.window("at", width, slide).alias("w"), "event_type").agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("started"), "event_type", "n")


def _micros(text: str) -> int:
    """Microseconds of a span such as ``6 hours``."""
    return int(pd.Timedelta(text).total_seconds() * 1_000_000)


def wall_runs(events: DataFrame, idle: str, wall: str, width: str = "30 days") -> DataFrame:
    """``user_id, started, ended, events, reason``: runs of events ``user_id, event_id, at`` that end at the earlier of
    two deadlines: ``idle`` after their last event, or ``wall`` after their first.

    An event at a deadline or later begins the next run; where both fall together the reason is ``wall``.
    Pauses cut the events into stretches first. Within a stretch each event points to the first one past
    its own wall; the runs are the chain of these pointers from the first event, and following
    pointers of doubled length finds the whole chain in as many rounds as its length has bits. Events are scanned in ranges of
    ``width``, so a user with very many is spread. Events with a null time are left out; a null user is a user;
    repeated events count each time. Times are given to the microsecond.
    """
    ensure_checkpoint_dir(events.sparkSession)
    gap, most, wide = _micros(idle), _micros(wall), _micros(width)
    placed = events.where("at is not null").select("user_id", F.unix_micros("at").alias("t")).groupBy("user_id", "t").agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("t") / wide)
    lagged = running(placed, ["user_id"], ["t"], {"_p": ("max", F.col("t"))}, bucket, inclusive=False)
    opened = F.when(F.col("_p").isNull() | (F.col("t") - F.col("_p") >= gap), F.col("t"))
    stretched = running(lagged, ["user_id"], ["t"], {"stretch": ("max", opened)}, bucket).drop("_p").checkpoint()
    keys = ["user_id", "stretch"]
    back = stretched.select(*keys, (-F.col("t")).alias("_b"), F.col("t").alias("next"))
    ahead = stretched.select(*keys, "t", (-F.col("t") - most).alias("_a"))
    jumps = asof(ahead, back, keys, "_a", "_b", ["next"], wide).select(*keys, "t", "next").where("next is not null").checkpoint()
    starts = stretched.where("t = stretch").select(*keys, "t").checkpoint()
    on = lambda left, right, a, b: (
        left["user_id"].eqNullSafe(right["_u"]) & (left["stretch"] == right["_s"]) & (left[a] == right[b]))
    while not jumps.isEmpty():
        named = jumps.select(F.col("user_id").alias("_u"), F.col("stretch").alias("_s"), F.col("t").alias("_t"), F.col("next").alias("_n"))
        met = starts.join(named, on(starts, named, "t", "_t")).select(*keys, F.col("_n").alias("t"))
        starts = starts.unionByName(met).distinct().checkpoint()
        jumps = jumps.join(named, on(jumps, named, "next", "_t")).select(*keys, "t", F.col("_n").alias("next")).checkpoint()
    marked = stretched.join(starts.select(F.col("user_id").alias("_u"), F.col("t").alias("_t")),
                            F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("t") == F.col("_t")), "left")
    owned = running(marked.select("user_id", "t", "n", "_t"), ["user_id"], ["t"], {"began": ("max", F.col("_t"))}, bucket)
    ends = F.least(F.max("t") + gap, F.col("began") + most)
    return owned.groupBy("user_id", "began").agg(
        ends.alias("ended"), F.sum("n").alias("events"), (F.col("began") + most <= F.max("t") + gap).alias("_w")).select(
        "user_id", F.timestamp_micros("began").alias("started"), F.timestamp_micros("ended").alias("ended"), "events",
        F.when(F.col("_w"), "wall").otherwise("idle").alias("reason"))


def stream_wall_runs(events: DataFrame, idle: str, wall: str, late: str) -> DataFrame:
    """The same runs from a stream, each once both its deadlines are certain.

    A user's state is the open run and the events that the watermark has not passed; a timer at the
    run's deadline closes it when no further event comes. Events later than the watermark are dropped by it.
    """
    gap, most = _micros(idle), _micros(wall)

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        began, last, n, held = state.get if state.exists else (0, 0, 0, [])
        held = list(held)
        for part in parts:
            held += [int(x.value // 1000) for x in part["at"]]
        now, held, out = state.getCurrentWatermarkMs() * 1000, sorted(held), []

        def close() -> None:
            wall_first = began + most <= last + gap
            out.append((key[0], pd.Timestamp(began, unit="us"), pd.Timestamp(min(began + most, last + gap), unit="us"), n, "wall" if wall_first else "idle"))

        sure = [t for t in held if t < now]
        held = held[len(sure):]
        for t in sure:
            if n and t >= min(began + most, last + gap):
                close()
                n = 0
            began, last, n = (began, t, n + 1) if n else (t, t, 1)
        if n and min(began + most, last + gap) <= now:
            close()
            n = 0
        if n or held:
            state.update((began, last, n, held))
            due = min([min(began + most, last + gap)] if n else held[:1])
            state.setTimeoutTimestamp(max(due // 1000 + 1, now // 1000 + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "started", "ended", "events", "reason"])

    return events.select("user_id", "at").withWatermark("at", late).groupBy("user_id").applyInPandasWithState(
        watch, "user_id long, started timestamp, ended timestamp, events long, reason string",
        "began long, last long, n long, held array<long>", "append", "EventTimeTimeout")


def stream_orphans(events: DataFrame, late: str, horizon: str) -> DataFrame:
    """Events ``scope, id, parent, at`` of a stream whose parent did not come before them.

    The stream is joined with itself on scope and parent, within ``horizon`` before the child; a
    child is told to be an orphan when the watermark has passed every time its parent could have. Repeated
    ids count once, as far as the watermark remembers them. A child without a parent is a root and no orphan.
    """
    once = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["scope", "id"])
    child = once.where("parent is not null").select("scope", "id", "parent", "at")
    above = once.select(F.col("scope").alias("_s"), F.col("id").alias("_i"), F.col("at").alias("_at"))
    met = F.expr(f"scope = _s and parent = _i and _at <= at and _at >= at - interval {horizon}")
    return child.join(above, met, "left_outer").where("_i is null").select("scope", "id", "parent", "at")
