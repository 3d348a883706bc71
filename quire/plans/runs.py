"""Run-event queries: the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans.base import Query, table
from quire.streaming import runs


def _events(spark, folder):
    return runs.stamped(table(spark, folder, "events"))


def _plain(rows, *columns):
    """Times as zone-free text, which both engines print alike."""
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


def idle_sessions(spark, folder):
    return _plain(runs.idle_sessions(_events(spark, folder), "6 hours"), "started", "ended")


S = """(SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))"""
FORMAT = "'%Y-%m-%d %H:%M:%S.%f'"
IDLE_SQL = f"""SELECT user_id, strftime(min(ts), {FORMAT}) AS started, strftime(max(ts) + INTERVAL 6 HOUR, {FORMAT}) AS ended, count(*) AS events
FROM {S} GROUP BY user_id, k"""


def session_deadlines(spark, folder):
    found = runs.deadlines(runs.idle_sessions(_events(spark, folder), "6 hours"), "6 hours", "4 hours")
    return found.groupBy("user_id", "reason").agg(F.count("*").alias("sessions"))


DEADLINE_SQL = f"""SELECT user_id, CASE WHEN b - a > INTERVAL 4 HOUR THEN 'wall' ELSE 'idle' END AS reason, count(*) AS sessions
FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM {S} GROUP BY user_id, k) GROUP BY ALL"""


def run_deadlines(spark, folder):
    """Runs that end a day after their last event or thirty hours after their first, whichever comes first."""
    return _plain(runs.wall_runs(_events(spark, folder), "24 hours", "30 hours"), "started", "ended")


RUNS_SQL = f"""
WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
r AS (SELECT user_id, i, ts AS began, ts AS last FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, CASE WHEN o.ts >= least(r.began + INTERVAL 30 HOUR, r.last + INTERVAL 24 HOUR) THEN o.ts ELSE r.began END, o.ts
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, strftime(began, {FORMAT}) AS started, strftime(least(began + INTERVAL 30 HOUR, max(last) + INTERVAL 24 HOUR), {FORMAT}) AS ended,
  count(*) AS events, CASE WHEN began + INTERVAL 30 HOUR <= max(last) + INTERVAL 24 HOUR THEN 'wall' ELSE 'idle' END AS reason FROM r GROUP BY user_id, began"""


def output_budget(spark, folder):
    return runs.byte_budget(table(spark, folder, "events"), F.length("props"), 300).select("user_id", "event_id", "used")


BUDGET_SQL = """
WITH t AS (SELECT user_id, event_id, ts, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM events)
SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, CAST(min(used) AS BIGINT) AS used FROM t WHERE used > 300 GROUP BY user_id"""


def severe_events(spark, folder):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").when(
        F.col("event_type") == "click", "DEBUG").when(F.col("event_type") == "view", "INFO")
    return runs.at_least(table(spark, folder, "events"), level, "WARNING").select("event_id", "user_id", "rank")


SEVERE_SQL = """SELECT event_id, user_id, CAST(CASE event_type WHEN 'error' THEN 4 ELSE 3 END AS BIGINT) AS rank FROM events WHERE event_type IN ('error', 'purchase')"""


def value_windows(spark, folder):
    return _plain(runs.outcome_counts(_events(spark, folder), "6 hours", "3 hours"), "started")


WINDOW_SQL = f"""SELECT strftime(w, {FORMAT}) AS started, event_type, count(*) AS n FROM (
  SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS w FROM events) GROUP BY ALL"""


def strict_properties(spark, folder):
    """Properties that hold exactly one whole number ``k``; others are told apart by their fault."""
    props = F.coalesce("props", F.lit(""))
    keys = F.json_object_keys(props)
    fault = (F.when(keys.isNull(), "not-an-object").when(~F.array_contains(keys, "k"), "missing-field")
             .when(F.size(F.array_distinct(keys)) != F.size(keys), "repeated-field").when(F.size(keys) > 1, "unknown-field")
             .when(F.try_to_number(F.get_json_object(props, "$.k"), F.lit("S999999999")).isNull(), "bad-value").otherwise("ok"))
    return table(spark, folder, "events").select(fault.alias("state"), F.get_json_object(props, "$.k").cast("bigint").alias("k")).groupBy(
        "state", "k").agg(F.count("*").alias("n"))


STRICT_SQL = """SELECT 'ok' AS state, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL"""


def sequence_breaks(spark, folder):
    """Orders of a customer whose key is not above every earlier order's."""
    from pyspark.sql.types import LongType

    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").cast(LongType()).alias("event_id"))
    return runs.contract_breaks(orders).groupBy("user_id").agg(F.count("*").alias("breaks"), F.max("highest").alias("highest"))


BREAKS_SQL = """
WITH t AS (SELECT o_custkey AS user_id, o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM orders)
SELECT user_id, count(*) AS breaks, max(highest) AS highest FROM t WHERE o_orderkey <= highest GROUP BY user_id"""

QUERIES = {
    "idle_sessions": Query(idle_sessions, IDLE_SQL, "STR-1"),
    "session_deadlines": Query(session_deadlines, DEADLINE_SQL, "STR-1"),
    "run_deadlines": Query(run_deadlines, RUNS_SQL, "STR-2"),
    "output_budget": Query(output_budget, BUDGET_SQL, "STR-3"),
    "severe_events": Query(severe_events, SEVERE_SQL, "STR-4"),
    "sequence_breaks": Query(sequence_breaks, BREAKS_SQL, "STR-5"),
    "value_windows": Query(value_windows, WINDOW_SQL, "STR-7"),
    "strict_properties": Query(strict_properties, STRICT_SQL, "SRC-6"),
}
