"""Scorecards on a planted recording with verdicts written by hand."""

import pytest
from pyspark.sql import functions as F

from roadlog.plans import catalogue, metrics

S = 1_000_000_000


def view(spark, fields, rows):
    """rows: (run, seconds, values ...)"""
    data = [(r[0], int(r[1] * S), i, *r[2:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"run_id long, t long, seq long{', ' + fields if fields else ''}")


def profile(t):
    """Speed of the planted drive: limit, slow zone from 20 s to 40 s with 2 s ramps, limit again."""
    high, low = 13.4112, 8.9408
    if t < 16:
        return high
    if t < 19:
        return high - (t - 16) / 3 * (high - low)
    if t < 40.5:
        return low
    if t < 43.5:
        return low + (t - 40.5) / 3 * (high - low)
    return high


@pytest.fixture(scope="module")
def drive(spark):
    """Run 1 is a good drive of 60 s; run 2 is the same but never engages and sends sparse status."""
    steps = [i / 10 for i in range(601)]
    engaged = lambda run, t: 4 if run == 1 and 2 <= t < 58 else 2
    fence = lambda t: 20 <= t < 40
    runs = (1, 2)
    return {
        "state": view(spark, "state int", [(r, t, engaged(r, t)) for r in runs for t in steps]),
        "geofence": view(spark, "is_on boolean, advisory double", [(r, t, fence(t), 8.9408) for r in runs for t in steps]),
        "route_state": view(spark, "lanelet_id long, cross_track double, down_track double, speed_limit double",
                            [(r, t, 9 if t < 10 else 3 if t < 30 else 4, 0.1 if r == 1 else (0.7 if 30 < t < 31 else 0.1), t * 10.0, 8.9408 if fence(t) else 13.4112)
                             for r in runs for t in steps]),
        "route": view(spark, "lanelets array<long>", [(1, 1, [9, 3, 4]), (2, 1, [9, 8])]),
        "twist": view(spark, "speed double", [(r, t, profile(t)) for r in runs for t in steps]),
        "platoon": view(spark, "state int, actual_gap double, desired_gap double",
                        [(1, t, 3 if t < 9 else 5 if t < 50 else 2 if t < 51 else 4, 10.0, 10.0) for t in steps]),
        "op_out": view(spark, "strategy string, operation string", [(1, t, "STATUS", "") for t in steps] + [(2, t, "STATUS", "") for t in (1.0, 30.0)]),
        "op_in": view(spark, "strategy string, operation string", [(1, t, "INFO", "") for t in steps if not 30 < t < 30.8]),
        "request_out": view(spark, "plan_type int", [(1, 5.0, 1), (1, 6.0, 2)]),
        "response_in": view(spark, "plan_type int, accepted boolean", [(1, 5.5, 1, True), (1, 6.5, 2, True)]),
        "control": view(spark, "choice int, closed int, maxspeed double, part int", [(1, 13.0, 12, 0, 8.9408, 1)]),
    }


def manifest(drive, run_id_view="state"):
    lanes = {"original_lanes": [3, 4], "closed_lanes": [4], "lane_order": [9, 3, 4]}
    rows = drive[run_id_view].select("run_id").distinct()
    return rows.withColumns({n: F.array(*[F.lit(x).cast("long") for x in v]) for n, v in lanes.items()})


def test_verdicts_follow_the_parameters_of_the_run(spark, drive):
    lists = lambda a, b: F.when(F.col("run_id") == 1, F.array(*[F.lit(x).cast("long") for x in a])).otherwise(F.array(*[F.lit(x).cast("long") for x in b]))
    runs = manifest(drive).withColumn("original_lanes", lists([3, 77], [8])).withColumn("lane_order", lists([3, 9], [3, 4]))
    got = {(r.run_id, r.metric_id): r.verdict for r in metrics.evaluate(catalogue.BASIC_TRAVEL, drive, runs).collect()}
    assert (got[(1, "B-1")], got[(2, "B-1")], got[(1, "B-5")], got[(2, "B-5")]) == ("failed", "passed", "failed", "passed")


def test_basic_travel_verdicts(spark, drive):
    runs = manifest(drive)
    got = {(r.run_id, r.metric_id): r.verdict for r in metrics.evaluate(catalogue.BASIC_TRAVEL, drive, runs).collect()}
    good = {m: v for (run, m), v in got.items() if run == 1}
    expected = {m.id: "passed" for m in catalogue.BASIC_TRAVEL.metrics}
    expected["B-24"] = "passed"         # one hole of 0.8 s among 60 s
    assert good == expected
    bad = {m: v for (run, m), v in got.items() if run == 2}
    assert bad["B-1"] == "failed" and bad["B-12"] == "not_evaluated" and bad["B-16"] == "not_evaluated"
    assert bad["B-2"] == "passed" and bad["B-6"] == "not_evaluated" and bad["B-20"] == "not_evaluated"


def test_scorecard_and_summary(spark, drive):
    results = metrics.evaluate(catalogue.BASIC_TRAVEL, drive, manifest(drive))
    card = {r.run_id: r.asDict() for r in metrics.scorecard(results, ["B-1", "B-16"]).collect()}
    assert card[1]["B-1"] == "passed" and card[2]["B-16"] == "not_evaluated"
    top = metrics.summary(results).where(F.col("use_case").isNull()).first()
    assert top.n == 2 * len(catalogue.BASIC_TRAVEL.metrics)


def test_anchors(spark, drive):
    times = {r.run_id: r for r in metrics.anchor_times(catalogue.BASIC_TRAVEL.anchors, drive, drive["state"].select("run_id")).collect()}
    assert (times[1].start, times[1].finish) == (2 * S, 58 * S)
    assert (times[1].enter, times[1].exit) == (20 * S, 40 * S)
    assert times[2].start is None and times[2].enter == 20 * S
    assert (times[1].accepted, times[1].joined) == (int(5.5 * S), int(6.5 * S))


def test_acks_and_pairs(spark):
    views = {
        "control": view(spark, "choice int, part int", [(1, 1.0, 5, 1), (1, 2.0, 5, 2), (2, 1.0, 5, 1)]),
        "ack": view(spark, "part int", [(1, 1.5, 1), (1, 2.9, 2)]),
        "route": view(spark, "lanelets array<long>", [(1, 3.0, [1])]),
    }
    case = metrics.UseCase("x", (), (
        metrics.Metric("ack", "acked", {"view": "control", "key": "part", "acks": "ack", "seconds": 1.0}),
        metrics.Metric("parts", "complete", {"view": "ack", "part": "part", "n": 2}),
        metrics.Metric("reroute", "paired_wait", {"calls": "control", "responses": "route", "seconds": 3.0}),
    ))
    got = {(r.run_id, r.metric_id): (r.value, r.verdict) for r in metrics.evaluate(case, views, views["control"].select("run_id")).collect()}
    assert got[(1, "ack")] == (pytest.approx(0.9), "passed") and got[(2, "ack")] == (None, "failed")
    assert got[(1, "parts")][1] == "passed" and got[(2, "parts")][1] == "not_evaluated"
    assert got[(1, "reroute")] == (float("inf"), "failed")


def test_runs_are_dealt_over_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    """However few bytes the shuffled rows have, a task orders a bounded number of rows; a run stays whole."""
    from pyspark.sql import functions as F

    from roadlog.plans import passes

    monkeypatch.setattr(passes, "TASK_ROWS", 50)
    rows = spark.range(1000).select(F.lit("a").alias("view"), (F.col("id") % 100).alias("run_id"), F.col("id").alias("t"), F.col("id").alias("seq"),
                                    F.struct(F.lit(True).alias("c0")).alias("v_a"))
    dealt = passes.timeline(rows, set()).df.withColumn("task", F.spark_partition_id())
    assert dealt.rdd.getNumPartitions() == 20
    assert dealt.groupBy("run_id").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] == 1
    assert dealt.count() == 1000


def test_rows_of_a_view_carry_no_columns_of_others(spark, monkeypatch):
    """Every view is ordered on its own; probes are ordered for the rules that ask for them only."""
    from roadlog.plans import passes

    seen, whole = [], passes.timeline

    def timeline(rows, probed, *args):
        seen.append(([c for c in rows.columns if c.startswith("v_")], len(probed)))
        return whole(rows, probed, *args)

    monkeypatch.setattr(passes, "timeline", timeline)
    views = {"a": view(spark, "x double", [(1, 1.0, 1.0), (1, 3.0, 2.0), (2, 1.0, 5.0)]), "b": view(spark, "y double", [(1, 2.0, 7.0), (1, 2.5, 9.0)])}
    case = metrics.UseCase("x", (metrics.Anchor("go", "first", "b", "y > 8"),), (
        metrics.Metric("late", "value_at", {"view": "a", "value": "x", "at": "go", "low": 2.0}),
        metrics.Metric("rate", "second_rate", {"view": "a", "value": "x", "limit": 0.4}),
        metrics.Metric("step", "value_gap", {"view": "a", "value": "x", "at": "go", "other_view": "b", "other_value": "y", "other_at": "go", "low": -8.0}),
    ))
    runs = views["a"].select("run_id").distinct()
    got = {(r.run_id, r.metric_id): (r.value, r.verdict) for r in metrics.evaluate(case, views, runs).collect()}
    assert got[1, "late"] == (2.0, "passed") and got[1, "rate"] == (0.5, "failed") and got[1, "step"] == (-7.0, "passed")
    assert {v for (run, _), (_, v) in got.items() if run == 2} == {"not_evaluated"} and len(got) == 6
    assert seen and all(len(columns) == 1 for columns, _ in seen)
    assert sorted(n for columns, n in seen if columns == ["v_a"]) == [0, 1]


def test_a_view_is_cut_for_its_own_rows(spark):
    """Runs that are over the row budget in one view are cut there only, as wide as that view's rows ask for."""
    from roadlog.operators.ordered import row_limit
    from roadlog.plans import passes

    rows = {v: spark.range(n).select(F.lit(v).alias("view"), F.lit(1).cast("long").alias("run_id"), F.col("id").alias("t"), F.col("id").alias("seq"),
                                     F.struct(F.lit(True).alias("c0")).alias(f"v_{v}")) for v, n in (("a", 15), ("b", 100))}
    with row_limit(20):
        log = passes.Log(rows)
        assert log.width("a") is None and 10 <= log.width("b") <= 30
        assert log.times().count() == 100
        assert log.ordered("a", False, None, []).width is None and log.ordered("b", False, None, []).df.count() == 100


def test_rows_are_ordered_only_where_the_order_is_asked(spark, monkeypatch):
    """First rows and counts are aggregated where the rows lie; methods stay small enough to be compiled while views are evaluated."""
    from roadlog.plans import passes

    dealt, limits, deal, write = [], [], passes.by_run, metrics.cut
    monkeypatch.setattr(passes, "by_run", lambda rows, n: dealt.append([c for c in rows.columns if c.startswith("v_")]) or deal(rows, n))
    monkeypatch.setattr(metrics, "cut", lambda df: limits.append(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) or write(df))
    views = {"a": view(spark, "x double", [(1, 1.0, 1.0), (1, 3.0, 2.0), (None, 1.0, 5.0)]), "b": view(spark, "y double", [(1, 2.0, 7.0), (1, 2.5, 9.0)])}
    case = metrics.UseCase("x", (metrics.Anchor("go", "first", "b", "y > 8"),), (
        metrics.Metric("late", "value_at", {"view": "a", "value": "x", "at": "go", "low": 2.0}),
        metrics.Metric("gap", "gap_max", {"view": "b", "limit": 1.0}),
    ))
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    got = {(r.run_id, r.metric_id): (r.value, r.verdict) for r in metrics.evaluate(case, views, views["a"].select("run_id").distinct()).collect()}
    assert got == {(1, "late"): (2.0, "passed"), (1, "gap"): (0.5, "passed"), (None, "late"): (None, "not_evaluated"), (None, "gap"): (None, "not_evaluated")}
    assert dealt == [["v_b"]]
    assert set(limits) == {"8000"} and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before


def test_a_cut_view_is_written_once_a_depth(spark, monkeypatch):
    """Running columns, those of the row before and those ahead take one step over a cut view, with the rows of an uncut one."""
    from roadlog.operators.ordered import Ordered
    from roadlog.plans import passes

    written, write = [], passes.cut
    monkeypatch.setattr(passes, "cut", lambda df: written.append(1) or write(df))
    rows = [(i % 3, None if i % 17 == 0 else i // 2 * 10, i, None if i % 4 == 1 else i) for i in range(90)]
    df = spark.createDataFrame(rows, "run_id long, t long, seq long, x long")
    found = []
    for width in (None, 100):
        steps = passes.Steps("s")
        was, n, then = steps.before(F.col("x")), steps.running("count", F.col("x")), steps.ahead(F.when(F.col("x") > 40, F.col("x")))
        late = steps.late("max", F.when(was < 50, n))
        o = steps.apply(Ordered(df, "run_id", "t", "seq", width, 3))
        found.append(sorted(map(str, o.df.select("run_id", "seq", was.alias("was"), n.alias("n"), then.alias("then"), late.alias("late")).collect())))
        assert len(written) == (0 if width is None else 2)
    assert found[0] == found[1] and len(found[0]) == 90


def test_anchors_take_only_the_rows_they_look_at(spark, monkeypatch):
    """What an anchor does not look at is left out before rows are joined or ordered; the times are those of all rows."""
    from roadlog.plans import passes

    seen, per_run = [], passes.per_run
    monkeypatch.setattr(passes, "per_run", lambda o, cells: seen.append(o.df.count()) or per_run(o, cells))
    views = {"a": view(spark, "x double", [(r, float(i), float(i % 5)) for r in (1, 2) for i in range(20)]),
             "b": view(spark, "y double", [(1, 7.0, 1.0), (2, 50.0, 1.0)])}
    anchors = (metrics.Anchor("go", "first", "b", "y > 0"), metrics.Anchor("hit", "last", "a", "x = 3", after="go"),
               metrics.Anchor("top", "first", "a", "x = 4"), metrics.Anchor("rise", "moves", "a", "x", after="hit", k=2, at="base"))
    got = {r.run_id: r for r in metrics.anchor_times(anchors, views, views["a"].select("run_id")).collect()}
    assert (got[1].go, got[1].hit, got[1].top, got[1].rise) == (7 * S, 18 * S, 4 * S, None)
    assert (got[2].go, got[2].hit, got[2].top, got[2].rise) == (50 * S, None, 4 * S, None)
    assert sorted(seen) == [2, 2, 3, 8]     # rise: 18 and 19 s of run 1; go: both rows; hit: 8, 13 and 18 s of run 1; top: 4 rows of each run


def test_rows_of_a_run_are_counted_only_in_views_over_the_budget(spark):
    """A view with no more rows than the budget has no run over it; what is kept for it is an upper bound."""
    from roadlog.operators.ordered import row_limit
    from roadlog.plans import passes

    rows = {v: spark.range(n).select(F.lit(v).alias("view"), (F.col("id") % 4).alias("run_id"), F.col("id").alias("t"), F.col("id").alias("seq"),
                                     F.struct(F.lit(True).alias("c0")).alias(f"v_{v}")) for v, n in (("a", 15), ("b", 40), ("c", 120))}
    with row_limit(20):
        log = passes.Log(rows)
        assert log.sizes == {"a": (15, 15), "b": (40, 10), "c": (120, 30)}
        assert log.width("a") is None and log.width("b") is None and log.width("c") is not None


def test_rules_without_anchors_do_not_wait_for_them(spark, monkeypatch):
    """A rule with a read of its own that names neither anchors nor cells is judged beside the anchors, with the same verdicts."""
    views = {"control": view(spark, "choice int, part int", [(1, 1.0, 5, 1), (1, 2.0, 5, 2)]), "ack": view(spark, "part int", [(1, 1.5, 1), (1, 2.9, 2)])}
    case = metrics.UseCase("x", (metrics.Anchor("go", "first", "control", "part = 2"),), (
        metrics.Metric("ack", "acked", {"view": "control", "key": "part", "acks": "ack", "seconds": 1.0}),
        metrics.Metric("after", "complete", {"view": "ack", "part": "part", "n": 1, "window": ("go", None)}),
        metrics.Metric("seen", "exists", {"view": "control", "holds": "choice = 5", "window": ("go", None)}),
    ))
    late, passed = [], metrics._passed
    monkeypatch.setattr(metrics, "_passed", lambda *args: late.extend(o[1].id for o in args[4]) or passed(*args))
    got = {r.metric_id: (r.value, r.verdict) for r in metrics.evaluate(case, views, views["control"].select("run_id")).collect()}
    assert got == {"ack": (pytest.approx(0.9), "passed"), "after": (1.0, "passed"), "seen": (1.0, "passed")}
    assert late == ["after"]
