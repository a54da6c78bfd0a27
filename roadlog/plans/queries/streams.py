"""Streaming queries, replayed over the events table and compared with batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...session import shared_dir, written
from ...sources import sinks
from ...streaming import sync, tail
from ..registry import DAY, EV, H, load, messages, micros, query


def _stream(spark, sf):
    rows = tail.tail_table(spark, sf, "events.parquet", load(spark, sf, "events").schema)
    t = micros("ts")
    return rows.select(F.col("user_id").alias("run_id"), t.alias("t"), F.timestamp_micros(t).alias("at"), F.col("event_id").alias("seq"),
                       F.col("event_type").alias("topic"), "value")


@query("rate_alarm_stream", "run_id:i t_from:i n:i alarm:b", f"""
WITH {EV}, w AS (SELECT run_id, t, unnest(range(t // {DAY} - 2, t // {DAY} + 1)) * {DAY} AS t_from FROM ev)
SELECT run_id, t_from, count(*) AS n, count(*) < 4 AS alarm FROM w WHERE t_from + {3 * DAY} <= (SELECT max(t) FROM ev) - {H} GROUP BY run_id, t_from""")
def rate_alarm_stream(spark, sf):
    alarms = tail.rate_alarm(_stream(spark, sf), "run_id", "at", "3 days", "1 day", "1 hour", 4)
    # a window comes out once, when no row for it can come any more
    return tail.replay(alarms).withColumn("t_from", F.unix_micros("from"))


@query("state_session_stream", "run_id:i t_from:i t_to:i n:i", f"""
WITH {EV}, a AS (SELECT run_id, t, lag(t) OVER (PARTITION BY run_id ORDER BY t, seq) AS pt FROM ev WHERE value > 30),
b AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt >= {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t) AS s FROM a)
SELECT run_id, min(t) AS t_from, max(t) + {DAY} AS t_to, count(*) AS n FROM b GROUP BY run_id, s HAVING max(t) + {DAY} <= (SELECT max(t) FROM a) - {H}""")
def state_session_stream(spark, sf):
    sessions = tail.state_sessions(_stream(spark, sf), "run_id", "at", F.col("value") > 30, "1 day", "1 hour")
    out = tail.replay(sessions)
    return out.withColumn("t_from", F.unix_micros("from")).withColumn("t_to", F.unix_micros("to"))


@query("first_report_stream", "run_id:i sim_time:i source:s n:i", f"""
WITH {EV} SELECT run_id, t // {3 * DAY} AS sim_time, topic AS source, 1 AS n FROM ev GROUP BY ALL""")
def first_report_stream(spark, sf):
    steps = _stream(spark, sf).select("run_id", F.floor(F.col("t") / F.lit(3 * DAY)).alias("sim_time"), F.col("topic").alias("source"), "at")
    first = tail.replay(tail.first_reports(steps, "run_id", "at", "40 days"))
    return first.groupBy("run_id", "sim_time", "source").agg(F.count(F.lit(1)).alias("n"))


@query("step_sync_stream", "run_id:i step:i first_next:i last_here:i lag:i synced:b", f"""
WITH {EV}, s AS (SELECT run_id, t // {3*DAY} AS step, topic, min(t) AS t FROM ev GROUP BY ALL),
g AS (SELECT run_id, step, count(*) AS n, min(t) AS lo, max(t) AS hi FROM s GROUP BY ALL)
SELECT a.run_id, a.step, b.lo AS first_next, a.hi AS last_here, b.lo - a.hi AS lag, b.lo > a.hi - {DAY} AS synced
FROM g a JOIN g b ON a.run_id = b.run_id AND b.step = a.step + 1 WHERE a.n = 5 AND b.n = 5""")
def step_sync_stream(spark, sf):
    steps = _stream(spark, sf).select("run_id", F.floor(F.col("t") / F.lit(3 * DAY)).alias("sim_time"), F.col("topic").alias("source"), F.col("t").alias("system_time"))
    judged = tail.replay(sync.sync_check_stream(steps, "run_id", 5, step=1, tolerance=DAY), wall_clock=True).where("not incomplete")
    return judged.withColumnRenamed("sim_time", "step")


# one source of each run has a clock that is a million steps ahead for its first report
_WRONG = f"""s0 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, seq) = 1 AS wrong FROM ev),
s AS (SELECT run_id, t // {3 * DAY} + CASE WHEN wrong THEN 1000000 ELSE 0 END AS step, topic, min(t) AS t FROM s0 GROUP BY ALL),
g AS (SELECT run_id, step, count(*) AS n, min(t) AS lo, max(t) AS hi FROM s GROUP BY ALL), z AS (SELECT run_id, max(step) FILTER (n >= 2) AS newest FROM g GROUP BY run_id),
j AS (SELECT a.run_id, a.step FROM g a JOIN g b ON a.run_id = b.run_id AND b.step = a.step + 1 WHERE a.n = 5 AND b.n = 5)"""


@query("step_sync_wrong_clock", "run_id:i step:i incomplete:b", f"""
WITH {EV}, {_WRONG} SELECT run_id, step, false AS incomplete FROM j
UNION ALL SELECT g.run_id, g.step, true FROM g JOIN z USING (run_id) ANTI JOIN j ON g.run_id = j.run_id AND g.step = j.step WHERE g.step < newest - 3""")
def step_sync_wrong_clock(spark, sf):
    first = load(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.min(F.struct(micros("ts"), "event_id"))["event_id"].alias("wrong"))
    steps = _stream(spark, sf).join(first, "run_id").select(
        "run_id", (F.floor(F.col("t") / F.lit(3 * DAY)) + F.when(F.col("seq") == F.col("wrong"), 1_000_000).otherwise(0)).alias("sim_time"),
        F.col("topic").alias("source"), F.col("t").alias("system_time"))
    judged = tail.replay(sync.sync_check_stream(steps, "run_id", 5, step=1, tolerance=DAY, late=3), wall_clock=True)
    return judged.withColumnRenamed("sim_time", "step")


@query("tail_appended", "file:s run_id:i sim_time:i n:i first_here:i last_here:i", f"""
WITH {EV} SELECT topic || '.log' AS file, run_id, t // {3 * DAY} AS sim_time, count(*) AS n, min(t) AS first_here, max(t) AS last_here FROM ev GROUP BY ALL""")
def tail_appended(spark, sf):
    """Logs that grow: a replay after each third of the recording, from one progress folder, reads what was appended since."""
    base = written(spark, f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}")
    log = messages(spark, sf)
    low, high = log.agg(F.min("t"), F.max("t")).first()
    line = F.concat_ws("", F.lit("run "), "run_id", F.lit(" Simulation Time: "), F.floor(F.col("t") / F.lit(3 * DAY)).cast("string"),
                       F.lit(" where current system time is: "), F.col("t").cast("string"))
    lines = log.select(F.concat("topic", F.lit(".log")).alias("file"), F.floor((F.col("t") - low) * 3 / F.lit(max(high - low, 1) + 1)).alias("part"), "t", "seq", line.alias("value"))
    run_id = F.regexp_extract("value", "run ([0-9]+) ", 1).cast("long")
    steps = None
    for part in range(3):
        sinks.append_lines(lines.where(F.col("part") == part), f"{base}/logs", "file", ["t", "seq"], "value")
        stream = tail.tail_steps(spark, f"{base}/logs", F.regexp_extract("file", "([^/]+)$", 1), [run_id.alias("run_id")], "*.log")
        steps = tail.replay(stream, base=f"{base}/replay")
    return steps.groupBy(F.col("source").alias("file"), "run_id", "sim_time").agg(
        F.count(F.lit(1)).alias("n"), F.min("system_time").alias("first_here"), F.max("system_time").alias("last_here"))
