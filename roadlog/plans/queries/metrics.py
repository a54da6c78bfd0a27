"""Scorecard queries: the use cases of the catalogue over views derived from the events table.

An hour of the events becomes 0.1 s of recording, so that a user's month is a run of 72 s.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...session import cut
from .. import metrics
from ..catalogue import USE_CASES
from ..registry import EV, messages, query
from . import metric_sql

T0 = 1704067200000000

# one SELECT per view, valid in both engines; msg has run_id, t, seq, topic, value, k, tens, lanes
VIEWS = {
    "state": "SELECT run_id, t, seq, CASE WHEN k < 92 THEN 4 ELSE 2 END AS state FROM msg",
    "route_state": "SELECT run_id, t, seq, tens AS lanelet_id, (value - 50) / 100 AS cross_track, t / 1e9 * 4 AS down_track, CASE WHEN k < 40 THEN 8.9408 ELSE 13.4112 END AS speed_limit FROM msg",
    "route": "SELECT run_id, t, seq, lanes AS lanelets FROM msg WHERE topic = 'signup'",
    "route_event": "SELECT run_id, t, seq, k % 4 AS event FROM msg WHERE topic = 'purchase'",
    "geofence": "SELECT run_id, t, seq, k BETWEEN 10 AND 60 AS is_on, CASE WHEN value < 150 THEN 8.9408 ELSE 11.0 END AS advisory FROM msg WHERE topic <> 'error'",
    "twist": "SELECT run_id, t, seq, value / 7 AS speed FROM msg",
    "platoon": "SELECT run_id, t, seq, 2 + k % 4 AS state, value / 5 AS actual_gap, 10.0 AS desired_gap FROM msg WHERE topic <> 'view'",
    "op_out": "SELECT run_id, t, seq, CASE WHEN k < 70 THEN 'STATUS' ELSE 'INFO' END AS strategy, CASE k % 4 WHEN 0 THEN 'PICKUP' WHEN 1 THEN 'DROPOFF' WHEN 2 THEN 'PORT_CHECKPOINT' ELSE 'HOLDING_AREA' END AS operation FROM msg WHERE topic IN ('click', 'view')",
    "op_in": "SELECT run_id, t, seq, CASE WHEN k < 30 THEN 'STATUS' ELSE 'INFO' END AS strategy, CASE k % 4 WHEN 0 THEN 'PICKUP' WHEN 1 THEN 'DROPOFF' WHEN 2 THEN 'PORT_CHECKPOINT' ELSE 'HOLDING_AREA' END AS operation FROM msg WHERE topic IN ('error', 'view')",
    "request_out": "SELECT run_id, t, seq, k % 3 AS plan_type FROM msg WHERE topic = 'signup'",
    "response_in": "SELECT run_id, t, seq, k >= 20 AS accepted FROM msg WHERE topic = 'click'",
    "control": "SELECT run_id, t, seq, CASE k % 4 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 2 THEN 12 ELSE 13 END AS choice, 1 + tens % 2 AS closed, CASE WHEN k < 70 THEN 8.9408 ELSE 13.4112 END AS maxspeed, k % 3 AS part FROM msg WHERE topic = 'error'",
    "ack": "SELECT run_id, t, seq, k % 3 AS part FROM msg WHERE topic = 'purchase'",
    "spat": "SELECT run_id, t, seq, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 8 END AS phase FROM msg WHERE topic <> 'signup'",
    "map": "SELECT run_id, t, seq FROM msg",
    "entry": "SELECT run_id, t, seq, tens AS lanelet_id, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 8 END AS phase FROM msg",
    "bsm": "SELECT run_id, t, seq, k < 50 AS siren, k < 70 AS light, value > 20 AS part2 FROM msg WHERE topic IN ('click', 'error')",
    "erv": "SELECT run_id, t, seq, k > 30 AS detected, CASE WHEN k > 60 THEN 'Attempting' WHEN k > 58 THEN 'Opposing' WHEN k > 40 THEN 'possible.' ELSE 'None' END AS action, value / 4 AS passing FROM msg WHERE topic = 'view'",
    "maneuver": "SELECT run_id, t, seq, k % 2 AS type, tens AS start_lane, k % 10 AS end_lane FROM msg WHERE topic = 'purchase'",
    "plan_points": "SELECT run_id, t, seq, CAST(floor(t / 4e9) AS BIGINT) AS plan, t AS target, 40 + value / 10 AS x, 48 + k / 20.0 AS y, CASE WHEN k % 3 = 0 THEN 'UnobstructedLaneChangePlugin' WHEN k % 7 = 0 THEN 'CooperativeLaneChangePlugin' ELSE 'inlane' END AS planner FROM msg WHERE topic IN ('view', 'purchase')",
    "trajectory": "SELECT run_id, t, seq, CASE WHEN k > 50 THEN '' ELSE 'inlane' END AS planner FROM msg WHERE topic <> 'purchase'",
    "pose": "SELECT run_id, t, seq, 45 + value / 20 AS x, 48 + k / 20.0 AS y FROM msg",
    "speed_target": "SELECT run_id, t, seq, value / 20 AS speed, CASE WHEN k < 10 THEN 0.0 WHEN k < 40 THEN 1.0 ELSE 2.5 END AS target FROM msg",
    "call": "SELECT run_id, t, seq FROM msg WHERE topic = 'click'",
    "plan": "SELECT run_id, t, seq FROM msg WHERE topic = 'view'",
    "ops": "SELECT run_id, t, seq, value AS x, k * 1.0 AS y, CASE topic WHEN 'click' THEN 'goal' WHEN 'purchase' THEN 'ack' END AS side FROM msg",
    "ui": "SELECT run_id, t, seq, k > 20 AS popup FROM msg WHERE topic = 'signup'",
    "warning": "SELECT run_id, t, seq FROM msg WHERE topic = 'error' AND k > 50",
}
MSG = f"""{EV}, msg AS (SELECT run_id, ((t - {T0}) * 250) // 9 AS t, seq, topic, value, k, k // 10 AS tens, [k // 10, k % 10, (k + 3) % 10] AS lanes FROM ev)"""
# the run manifest: runs of even and odd number have different parameters (name: Spark SQL, DuckDB SQL)
_LISTS = {"original_lanes": ("3, 4", "4, 9"), "closed_lanes": ("4", "2, 7"), "lane_order": ("9, 3, 4", "1, 2"), "port_order": ("1, 2", "7, 3"),
          "right_lanes": ("0, 1, 2", "5, 6"), "middle_lanes": ("3, 4, 2", "0, 1, 9")}
_NUMBERS = {"right_lane": ("5", "7"), "port_lane": ("5", "3"), "stop_x": ("50.0", "47.0"), "stop_y": ("50.0", "51.0"), "stop_offset": ("5.0", "0.0"), "bumper": ("1.5", "4.0"), "opposing": ("false", "true")}
_EITHER = "CASE WHEN run_id % 2 = 0 THEN {} ELSE {} END"
RUNS = {**{n: _EITHER.format(f"[{a}]", f"[{b}]") for n, (a, b) in _LISTS.items()}, **{n: _EITHER.format(a, b) for n, (a, b) in _NUMBERS.items()}}


def manifest(msg):
    """One row per run with its parameters."""
    long_list = lambda x: f"array({', '.join(f'{v.strip()}L' for v in x.split(','))})"
    columns = {**{n: _EITHER.format(long_list(a), long_list(b)) for n, (a, b) in _LISTS.items()}, **{n: _EITHER.format(a, b) for n, (a, b) in _NUMBERS.items()}}
    return cut(msg.select("run_id").distinct()).select("run_id", *[F.expr(sql).alias(n) for n, sql in columns.items()])


def recording(spark, sf):
    """The message log in recording time."""
    tens = F.floor(F.col("k") / 10)
    return messages(spark, sf).select(
        "run_id", F.floor((F.col("t") - T0) * 250 / 9).cast("long").alias("t"), "seq", "topic", "value", "k", tens.alias("tens"),
        F.array(tens, F.col("k") % 10, (F.col("k") + 3) % 10).alias("lanes"))


def results_of(msg, *names):
    """Verdicts of use cases over the views of a message log."""
    spark, cases = msg.sparkSession, [USE_CASES[n] for n in names]
    msg = cut(msg)      # every view and the manifest read it
    views = {name: spark.sql(VIEWS[name].replace("FROM msg", "FROM {msg}"), msg=msg) for u in cases for name in metrics.views_of(u)}
    return metrics.evaluate_all(cases, views, manifest(msg))


def _register(name):
    sql = metric_sql.use_case_sql(name, MSG, VIEWS, RUNS)

    @query(f"metrics_{name}", "use_case:s run_id:i metric_id:s value:f verdict:s", sql)
    def run(spark, sf):
        return results_of(recording(spark, sf), name)


for _name in USE_CASES:
    _register(_name)


_CARD = [m.id for m in USE_CASES["scale_vehicle"].metrics]
_NAMES = {i: "c" + i.removeprefix("SV-").replace("-", "_") for i in _CARD}


@query("scorecard", "run_id:i " + " ".join(f"{n}:s" for n in _NAMES.values()), f"""
SELECT run_id, {", ".join(f"max(verdict) FILTER (metric_id = '{i}') AS {n}" for i, n in _NAMES.items())}
FROM ({metric_sql.use_case_sql('scale_vehicle', MSG, VIEWS, RUNS)}) GROUP BY run_id""")
def scorecard(spark, sf):
    results = results_of(recording(spark, sf), "scale_vehicle")
    return metrics.scorecard(results, _CARD).withColumnsRenamed(_NAMES)


@query("scorecard_rollup", "use_case:s metric_id:s n:i n_passed:i n_skipped:i", f"""
SELECT use_case, metric_id, count(*) AS n, count(*) FILTER (verdict = 'passed') AS n_passed, count(*) FILTER (verdict = 'not_evaluated') AS n_skipped
FROM ({" UNION ALL ".join(f"SELECT * FROM ({metric_sql.use_case_sql(u, MSG, VIEWS, RUNS)})" for u in USE_CASES)})
GROUP BY ROLLUP (use_case, metric_id)""")
def scorecard_rollup(spark, sf):
    return metrics.summary(results_of(recording(spark, sf), *USE_CASES))
