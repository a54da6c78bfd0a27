"""Operators against naive loops on random logs, with plain windows and with every entity cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlog.operators import anchored, asof, hysteresis, intervals, matching, rates, rolling, spatial, stats, trajectory
from roadlog.operators.ordered import Ordered, chunk_width, row_limit
from roadlog.streaming import sync


def log(spark, seed, entities=3, rows=40, values=6, step=9):
    """Random rows (id, t, seq, v); one entity holds most of them, times repeat."""
    rng = random.Random(seed)
    data, seq = [], 0
    for e in range(entities):
        t = 0
        for _ in range(rows if e == 0 else rng.randint(1, rows // 4)):
            t += rng.choice([0, 1, 2, step])
            data.append((e, t, seq, float(rng.randint(0, values))))
            seq += 1
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "id long, t long, seq long, v double")


def per_entity(data):
    out = {}
    for row in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def same(got, expected):
    assert sorted(got, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_neighbours_and_running_values(spark, mode, seed):
    data, df = log(spark, seed)
    o = Ordered.of(df, "id", "t", "seq").prev(p="v").next(n="v").number("rn").number("back", backward=True)
    o = o.running(total=("sum", "v"), top=("max", "v"), low=("min", "v"), known=("last", F.when(F.col("v") > 3, F.col("v"))))
    o = o.ahead(coming=F.when(F.col("v") > 3, F.col("v")))
    expected = []
    for rows in per_entity(data).values():
        vs = [r[3] for r in rows]
        for i, r in enumerate(rows):
            big = [v for v in vs[:i + 1] if v > 3]
            ahead = [v for v in vs[i:] if v > 3]
            expected.append((r[2], vs[i - 1] if i else None, vs[i + 1] if i + 1 < len(vs) else None, i + 1, len(vs) - i, sum(vs[:i + 1]),
                             max(vs[:i + 1]), min(vs[:i + 1]), big[-1] if big else None, ahead[0] if ahead else None))
    same(rows_of(o.df, "seq", "p", "n", "rn", "back", "total", "top", "low", "known", "coming"), expected)


@pytest.mark.parametrize("seed", range(2))
def test_row_and_time_frames(spark, mode, seed):
    data, df = log(spark, seed)
    o = Ordered.of(df, "id", "t", "seq").rows(2, 1, total=lambda w: F.sum("v").over(w)).span(5, 2, near=lambda w: F.count(F.lit(1)).over(w))
    expected = []
    for rows in per_entity(data).values():
        for i, r in enumerate(rows):
            expected.append((r[2], sum(x[3] for x in rows[max(0, i - 2):i + 2]), sum(1 for x in rows if r[1] - 5 <= x[1] <= r[1] + 2)))
    same(rows_of(o.df, "seq", "total", "near"), expected)


def test_split_mode_really_cuts(spark, mode):
    _, df = log(spark, 1)
    assert (chunk_width(df, ["id"], "t") is not None) == (mode == "split")


def odd_log(spark):
    """A log with a null entity, null times, times that are no number and a hot entity."""
    rng = random.Random(4)
    data = [(rng.choice([None, 1, 1, 1, 2]), rng.choice([None, *[float(x) for x in range(30)], float("nan")]), i, float(rng.randint(0, 5))) for i in range(90)]
    return spark.createDataFrame(data, "id long, t double, seq long, v double")


def test_null_entities_and_times_are_the_same_cut_and_uncut(spark):
    df = odd_log(spark)

    def results():
        o = Ordered.of(df, "id", "t", "seq").prev(p="v").next(n="v").number("rn").running(total=("sum", "v"), low=("min", "v"))
        o = o.span(3, 1, near=lambda w: F.count(F.lit(1)).over(w)).rows(1, 1, around=lambda w: F.sum("v").over(w))
        marks = stats.quantiles(df, "id", "v", [0.0, 0.25, 0.5, 1.0])
        return (rows_of(o.df, "seq", "p", "n", "rn", "total", "low", "near", "around"), rows_of(marks, "id", "n", "q"),
                rows_of(stats.group_stats(df, "id", "v"), "id", "median", "count"), rows_of(stats.describe(df, "id", "v"), "id", "q25", "q50", "max"),
                rows_of(hysteresis.hysteresis_changes(df.where("not isnan(t)"), "id", "t", "seq", "v", 1.0), "id", "seq", "value"))

    plain = results()
    assert len(plain[0]) == 90 and {r[0] for r in plain[1]} == {None, 1, 2} and all(r[1] is not None for r in plain[2])
    names = {"spark.roadlog.chunkRows": "7", "spark.roadlog.buckets": "3"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        assert results() == plain
    finally:
        for name in names:
            spark.conf.unset(name)


def test_hysteresis_summary_of_a_steady_rise_is_short():
    values = np.arange(20_000) * 0.5
    text = hysteresis._summary(values, 10.0)
    assert len(text) < 5_000
    for state in (-30.0, -5.0, 0.0, 3.3, 9.0, 12.0, 500.0):
        last, kept = state, hysteresis._accepted(values, state, 10.0)[0]
        assert hysteresis._enter(text, state, 10.0) == (values[kept[-1]] if kept else last)


def test_hysteresis_skips_missing_values(spark, mode):
    data = [(1, i, i, v) for i, v in enumerate([None, 1.0, float("nan"), 5.0, None, 9.0, 9.5, 2.0, 20.0])]
    df = spark.createDataFrame(data, "id long, t long, seq long, v double")
    got = rows_of(hysteresis.hysteresis_changes(df, "id", "t", "seq", "v", 1.0), "t", "value")
    same(got, [(1, 1.0), (3, 5.0), (5, 9.0), (7, 2.0), (8, 20.0)])


@pytest.mark.parametrize("seed", range(2))
def test_resetting_sum(spark, mode, seed):
    data, df = log(spark, seed)
    expected = []
    for rows in per_entity(data).values():
        total, before = 0, None
        for r in rows:
            gap = None if before is None else r[1] - before
            total = total + gap if gap is not None and gap <= 2 else 0
            expected.append((r[2], total))
            before = r[1]
    same(rows_of(rolling.resetting_sum(df, "id", "t", "seq", 2), "seq", "duration"), expected)


@pytest.mark.parametrize("seed", range(2))
def test_state_intervals(spark, mode, seed):
    data, df = log(spark, seed, values=2)
    expected = []
    for e, rows in per_entity(data).items():
        start = last = None
        for r in rows:
            if r[3] >= 1:
                start = r[1] if start is None else start
                last = r[1]
            elif start is not None:
                expected.append((e, start, r[1]))
                start = None
        if start is not None:
            expected.append((e, start, last))
    same(rows_of(intervals.state_intervals(df, "id", "t", "seq", F.col("v") >= 1), "id", "start", "end"), expected)


def naive_fifo(sources, targets, limit=None):
    """Targets in order take the first unused source of their key that is early enough."""
    left, out = list(sources), []
    for key, t, seq in targets:
        hit = next((s for s in left if s[0] == key and s[1] <= t and (limit is None or t - s[1] < limit)), None)
        if hit:
            left.remove(hit)
        out.append((key, seq, hit[1] if hit else None))
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limit", [None, 6])
def test_fifo_matching(spark, mode, seed, limit):
    rng = random.Random(seed)
    make = lambda n: sorted((rng.choice([0, 0, 0, 1]), rng.randint(0, 60), i) for i in range(n))
    sources, targets = make(25), make(25)
    sources.sort(key=lambda r: (r[1], r[2]))
    targets.sort(key=lambda r: (r[1], r[2]))
    schema = "key long, t long, seq long"
    s, g = spark.createDataFrame(sources, schema), spark.createDataFrame(targets, schema)
    if limit is None:
        got = matching.fifo_match(s, g, "key", "t", source_tie="seq", target_tie="seq", keep_target=("seq",))
    else:
        got = matching.fifo_match_bounded(s, g, "key", "t", limit, source_tie="seq", target_tie="seq", keep_target=("seq",))
    same(rows_of(got, "key", "seq", "t_source"), naive_fifo(sources, targets, limit))


@pytest.mark.parametrize("seed", range(2))
def test_drop_repeats_follows_the_growing_list(spark, mode, seed):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(60):
        t += rng.choice([0, 1, 2, 3, 9])
        rows.append((rng.choice([0, 0, 1]), t, i, rng.choice("abc")))
    kept = []
    for key, t, i, port in rows:
        found = False
        for entry in kept:
            if entry[0] == key and abs(t - entry[1]) <= 2 and entry[2] != port:
                entry[1], entry[2], found = t, port, True
        if not found:
            kept.append([key, t, port])
    df = spark.createDataFrame(rows, "key long, t long, seq long, port string")
    same(rows_of(matching.drop_repeats(df, "key", "t", "port", 2, "seq"), "key", "t", "port"), [tuple(k) for k in kept])


@pytest.mark.parametrize("seed", range(2))
def test_hysteresis(spark, mode, seed):
    data, df = log(spark, seed, values=9)
    expected = []
    for rows in per_entity(data).values():
        last = None
        for r in rows:
            if last is None or abs(r[3] - last) > 2.5:
                expected.append((r[2], r[3]))
                last = r[3]
    same(rows_of(hysteresis.hysteresis_changes(df, "id", "t", "seq", "v", 2.5), "seq", "value"), expected)


@pytest.mark.parametrize("seed", range(2))
def test_anchored_windows(spark, mode, seed):
    data, df = log(spark, seed)
    expected = []
    for e, rows in per_entity(data).items():
        start, n = None, 0
        for r in rows:
            second = r[1] // 2
            if start is not None and second < start + 5:
                n += 1
                continue
            if start is not None:
                expected.append((e, start, n, True))
            start, n = second, 1
        expected.append((e, start, n, False))
    same(rows_of(anchored.anchored_windows(df, "id", "t", slot=2, length=5), "id", "start", "n", "closed"), expected)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof(spark, mode, seed, direction, exact):
    left, ldf = log(spark, seed, rows=20)
    right, rdf = log(spark, seed + 50, rows=20)
    expected = []
    for e, t, seq, _ in left:
        mine = sorted(r[1] for r in right if r[0] == e)
        back = [x for x in mine if x < t or (exact and x == t)]
        ahead = [x for x in mine if x > t or (exact and x == t)]
        b, a = (back[-1] if back else None), (ahead[0] if ahead else None)
        if direction == "nearest":
            hit = b if b is not None and (a is None or t - b < a - t) else a
        else:
            hit = b if direction == "backward" else a
        expected.append((seq, hit))
    r = rdf.select("id", "t", F.col("t").alias("hit"), "seq")
    got = asof.asof_join(ldf, r, "id", "t", direction=direction, allow_exact=exact, columns=["hit"], right_tie="seq")
    same(rows_of(got, "seq", "hit"), expected)


def test_asof_tie_order(spark, mode):
    left = spark.createDataFrame([(1, 5)], "id long, t long")
    right = spark.createDataFrame([(1, 5, s, f"r{s}") for s in (2, 1, 3)], "id long, t long, s long, name string")
    pick = lambda d: asof.asof_join(left, right, "id", "t", direction=d, columns=["name"], right_tie="s").first().name
    assert (pick("backward"), pick("forward")) == ("r3", "r1")


@pytest.mark.parametrize("seed", range(2))
def test_quantiles(spark, mode, seed):
    data, df = log(spark, seed, rows=60, values=1000)
    got = {r.id: r.q for r in stats.quantiles(df, "id", "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for e, rows in per_entity(data).items():
        assert got[e] == pytest.approx(np.percentile([r[3] for r in rows], [0, 25, 50, 90, 100]))


def test_linear_resampling(spark, mode):
    rng = random.Random(4)
    ts = np.cumsum([rng.choice([0.3, 0.7, 1.9]) for _ in range(30)])
    xs = np.array([rng.uniform(0, 9) for _ in ts])
    df = spark.createDataFrame([(1, float(t), float(x)) for t, x in zip(ts, xs)], "id long, t double, x double")
    got = {round(r.t, 6): r.x for r in trajectory.resample_linear(df, "id", "t", (), ["x"], 0.5).collect()}
    grid = np.arange(np.ceil(ts[0] / 0.5), np.floor(ts[-1] / 0.5)) * 0.5
    assert sorted(got) == pytest.approx(list(grid))
    assert [got[round(t, 6)] for t in grid] == pytest.approx(list(np.interp(grid, ts, xs)))


@pytest.mark.parametrize("n", [9, 700])
def test_spline_in_blocks_equals_the_whole_solution(spark, n):
    rng = np.random.default_rng(3)
    ts = np.cumsum(rng.uniform(0.5, 1.5, n))
    xs = np.sin(ts / 7) * 10 + rng.normal(0, 0.1, n)
    df = spark.createDataFrame([(1, float(t), float(x)) for t, x in zip(ts, xs)], "id long, t double, x double")
    got = sorted((r.t, r.x) for r in trajectory.resample_spline(df, "id", "t", (), ["x"], 0.4).collect())
    at = np.array([g[0] for g in got])
    assert at == pytest.approx(ts[0] + 0.4 * np.arange(len(at))) and at[-1] > ts[-1] - 0.41
    assert [g[1] for g in got] == pytest.approx(trajectory.spline_values(ts, xs, at, 5), abs=1e-6)


def test_spline_reproduces_a_quintic():
    x = np.linspace(0, 3, 12)
    polynomial = lambda t: 2 * t**5 - t**3 + 4 * t - 1
    at = np.linspace(0, 3, 50)
    assert trajectory.spline_values(x, polynomial(x), at, 5) == pytest.approx(polynomial(at))


@pytest.mark.parametrize("block", [64, 1, 5])
def test_nearest_point(spark, mode, block, monkeypatch):
    monkeypatch.setattr(spatial, "LEAST_BLOCK", block)
    rng = random.Random(9)
    route = [(e, i, rng.uniform(0, 50), rng.uniform(0, 50)) for e in (1, 2) for i in range(2 if e == 2 else 400)]
    points = [(rng.choice([1, 2]), i, rng.uniform(-80, 130), rng.uniform(-80, 130)) for i in range(40)]
    points += [(1, 100, 7.0, 7.0), (1, 101, 7.0, 7.0), (1, 102, None, 7.0), (1, 102, None, 7.0), (3, 103, 1.0, 1.0)]
    r = spark.createDataFrame([*route, (1, 900, None, 5.0)], "id long, place long, x double, y double")
    p = spark.createDataFrame(points, "id long, seq long, x double, y double")
    expected = []
    for e, seq, x, y in points:
        if e != 3:
            near = min((np.hypot(a - x, b - y), i) for k, i, a, b in route if k == e) if x is not None else (None, None)
            expected.append((seq, near[1]))
    same(rows_of(spatial.nearest_point(p, r, "id", place="place"), "seq", "near_place"), expected)


@pytest.mark.parametrize("legs", [256, 3])
def test_crossings_of_random_paths(spark, mode, legs, monkeypatch):
    monkeypatch.setattr(spatial, "FIRST_LEGS", legs)
    rng = random.Random(12)
    walk = lambda n: [(1, t, rng.uniform(-500, 500) if t % 9 == 0 else rng.uniform(0, 40), rng.uniform(-60, 60)) for t in range(n)]
    a, b = walk(40), walk(40)
    schema = "id long, t long, x double, y double"
    found = []
    for (_, t, x, y), (_, _, x2, y2) in zip(a, a[1:]):
        for (_, u, z, w), (_, _, z2, w2) in zip(b, b[1:]):
            turn = (x2 - x) * (w2 - w) - (y2 - y) * (z2 - z)
            p = ((z - x) * (w2 - w) - (w - y) * (z2 - z)) / turn if turn else -1
            q = ((z - x) * (y2 - y) - (w - y) * (x2 - x)) / turn if turn else -1
            if 0 <= p <= 1 and 0 <= q <= 1:
                found.append((t + p, u + q))
    for cell in (3.0, 50.0):
        hit = spatial.conflict_point(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", "t", cell).first()
        assert (hit.t_a, hit.t_b) == pytest.approx(min(found))


def test_offset_search_tries_the_whole_overlap(spark):
    rng = random.Random(3)
    ref = [(1, i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(1, 101)]
    sensor = [(1, i - 45, x, y) for _, i, x, y in ref if 45 < i <= 85]
    schema = "id long, i long, x double, y double"
    got = spatial.offset_search(spark.createDataFrame(ref, schema), spark.createDataFrame(sensor, schema), "id", "i",
                                lambda a, b: F.hypot(a("x") - b("x"), a("y") - b("y"))).first()
    assert (got.offset, got.error) == (45, 0.0)


def test_spline_by_length_follows_a_straight_path(spark, mode):
    rng = random.Random(3)
    way = [0.0]
    for _ in range(60):
        way.append(way[-1] + rng.uniform(0.5, 2.0))
    df = spark.createDataFrame([(1, i, 0.6 * s, 0.8 * s) for i, s in enumerate(way)], "id long, t long, x double, y double")
    got = trajectory.resample_by_length(df, "id", "t", (), 1.0).collect()
    assert len(got) > 30 and all((r.x, r.y) == pytest.approx((0.6 * r.s, 0.8 * r.s)) for r in got)


def test_azimuth_on_the_ellipsoid(spark):
    from roadlog.functions import geo

    lit = lambda *v: [F.lit(x) for x in v]
    row = spark.range(1).select(geo.azimuth(*lit(0.0, 0.0, 0.0, 1.0)).alias("east"), geo.azimuth(*lit(10.0, 5.0, 11.0, 5.0)).alias("north"),
                                geo.azimuth(*lit(45.0, 0.0, 45.01, 0.01)).alias("a"), geo.bearing(*lit(45.0, 0.0, 45.01, 0.01)).alias("b")).first()
    # one hundredth of a degree at 45 degrees north: 1111.4 m north, 788.5 m east on the ellipsoid
    assert (row.east, row.north) == pytest.approx((90.0, 0.0)) and row.a == pytest.approx(np.degrees(np.arctan2(788.47, 1111.32)), abs=0.02) and 0.05 < abs(row.a - row.b) < 0.3


def test_path_reached_waits_at_branches(spark, mode):
    # 0 forks to 1 and 5; 1-2-3-4 and 5-6-7 are single ways
    edges = spark.createDataFrame([(0, 1), (0, 5), (1, 2), (2, 3), (3, 4), (5, 6), (6, 7)], "src long, dst long")
    visits = [0, 1, 5, 1, 2, 3, 9, 4, 2, 0] + [4] * 12
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(visits)] + [(2, i, i, v) for i, v in enumerate([0, 5, 6, 7])], "id long, t long, seq long, node long")
    got = [tuple(r) for r in spatial.path_reached(df, edges, "id", "t", "seq", "node").select("id", "src", "dst", "hops", "via").orderBy("id", "t").collect()]
    assert got == [(1, 0, 3, 3, "1-2"), (1, 3, 4, 1, ""), (2, 0, 7, 3, "5-6")]


def test_first_crossing_of_paths(spark, mode):
    a = [(1, t, float(t), 0.0) for t in range(40)]
    b = [(1, t, 17.5, float(t - 10)) for t in range(20)]
    schema = "id long, t long, x double, y double"
    hit = spatial.conflict_point(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "id", "t", 4.0).collect()
    assert [(h.x, h.y, h.t_a, h.t_b) for h in hit] == [(17.5, 0.0, 17.5, 10.0)]


def test_encroachment_on_straight_paths(spark):
    # the walker leaves the zone around (20, 0) at 21.1 s, the vehicle (5 m/s, 3 s behind) enters at 27 s
    walker = [(1, t * 100.0, 20.0, -20.0 + t * 0.1) for t in range(400)]
    vehicle = [(1, t * 100.0, -111.0 + t * 0.5, 0.0) for t in range(400)]
    schema = "id long, t double, x double, y double"
    out = trajectory.encroachment(
        spark.createDataFrame(vehicle, schema), spark.createDataFrame(walker, schema), "id", "t", (), zone=2.0, cell=5.0,
        enter_step=10.0, exit_step=100.0, accel=3.0, top_speed=13.41, buffer=3.0).first()
    assert out.walker_exit == pytest.approx(21000, abs=101)
    assert out.vehicle_enter == pytest.approx(26010, abs=11)
    assert out.pet == pytest.approx(out.vehicle_enter - out.walker_exit)
    metres = out.distance
    assert metres == pytest.approx((out.pet - 20) / 1000 * 5, abs=0.2)
    assert out.expected_pet == pytest.approx((5 / 3 + (metres - 25 / 6) / 5 + 3) * 1000, abs=30)


def below(plan, wanted, stop):
    """Whether a node of the physical plan has one named `wanted` under it, not looking beyond those named `stop`."""
    if plan.nodeName().startswith(wanted):
        return True
    children = plan.children()
    return not plan.nodeName().endswith(stop) and any(below(children.apply(i), wanted, stop) for i in range(children.size()))


def broadcasts(plan):
    """The nodes under each broadcast of a physical plan."""
    plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    children = plan.children()
    found = [children.apply(i) for i in range(children.size())]
    return (found if plan.nodeName() == "BroadcastExchange" else []) + [b for c in found for b in broadcasts(c)]


@pytest.mark.parametrize("smooth", [True, False])
def test_encroachment_broadcasts_no_grid(spark, tmp_path, smooth):
    # tables in files, as Spark takes their grids for as small as the files
    schema = "id long, t double, x double, y double"
    for name, rows in (("walker", [(1, t * 100.0, 20.0, -20.0 + t * 0.1) for t in range(400)]), ("vehicle", [(1, t * 100.0, -111.0 + t * 0.5, 0.0) for t in range(400)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    walker, vehicle = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("walker", "vehicle"))
    out = trajectory.encroachment(vehicle, walker, "id", "t", (), zone=2.0, cell=5.0, enter_step=10.0, exit_step=100.0, accel=3.0, top_speed=13.41,
                                  buffer=3.0, smooth=smooth)
    crossing = spatial._crossings(spatial.segments(vehicle, "id", "t"), spatial.segments(walker, "id", "t"), ["id"], 5.0)
    sent = [b for df in (out, crossing) for b in broadcasts(df._jdf.queryExecution().executedPlan())]
    assert not [b.treeString() for b in sent if below(b, "MapInPandas", "Aggregate") or below(b, "Generate", "Aggregate")]
    assert out.count() == 1


def test_conflict_scan_sees_standing_and_moving(spark, mode):
    own = [(1, t * 1000, float(t * 10), 0.0, 10.0) for t in range(10)] + [(2, t * 1000, 0.0, 0.0, 0.0) for t in range(10)]
    other = [(1, t * 1000, 62.0, 20.0 - t * 2) for t in range(10)] + [(2, t * 1000, float(20 - t * 4), 0.0) for t in range(10)]
    o = spark.createDataFrame(own, "id long, t long, x double, y double, v double")
    w = spark.createDataFrame(other, "id long, t long, x double, y double")
    got = {(r.id, r.t): r.ttc for r in spatial.conflict_scan(o, w, "id", "t", 5.0).collect()}
    # the other one is 20 - 2t away from the path at x = 62: closer than 5 from 7.5 s on
    assert got[(1, 0)] is None
    assert [got[(2, t * 1000)] for t in range(7)] == [None, None, None, None, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("horizon", [None, 6.0])
def test_conflict_scan_against_all_pairs(spark, mode, horizon):
    rng = random.Random(8)
    own, other = [], []
    for e in (1, 2):
        x = y = 0.0
        for t in range(40):
            own.append((e, float(t), x, y, rng.choice([0.0, 1.0, 3.0])))
            x, y = x + rng.choice([0.0, 1.0, 2.0]), y + rng.uniform(-1, 1)
        other += [(e, 2.0 * t, rng.uniform(0, 40), rng.uniform(-3, 3)) for t in range(30)]
    expected = []
    for e in (1, 2):
        path, track = [r for r in own if r[0] == e], [r for r in other if r[0] == e]
        way = [0.0]
        for a, b in zip(path, path[1:]):
            way.append(way[-1] + float(np.hypot(b[2] - a[2], b[3] - a[3])))

        def close(at, px, py):
            for a, b in zip(track, track[1:]):
                if a[1] <= at <= b[1]:
                    u = (at - a[1]) / (b[1] - a[1])
                    return np.hypot(a[2] + u * (b[2] - a[2]) - px, a[3] + u * (b[3] - a[3]) - py) < 2.0
            return False

        for i, (_, t, x, y, v) in enumerate(path):
            hits = [0.0] if v < 0.01 and close(t, x, y) else []
            for j in range(i + 1, len(path)):
                if v >= 0.01 and way[j] > way[j - 1]:
                    travel = (way[j] - way[i]) / v
                    if (horizon is None or travel <= horizon) and close(t + travel, path[j][2], path[j][3]):
                        hits.append(travel)
            expected.append((e, t, round(min(hits), 6) if hits else None))
    o = spark.createDataFrame(own, "id long, t double, x double, y double, v double")
    w = spark.createDataFrame(other, "id long, t double, x double, y double")
    got = spatial.conflict_scan(o, w, "id", "t", 2.0, horizon, unit=1.0)
    same([(r.id, r.t, None if r.ttc is None else round(r.ttc, 6)) for r in got.collect()], expected)


def test_sync_check(spark):
    steps = [(1, s, src, 1000 * s // 100 + d) for s in (0, 100, 200, 300) for src, d in (("a", 0), ("b", 3))]
    steps = [x for x in steps if x[1:3] != (300, "b")] + [(1, 100, "a", 5000)]
    df = spark.createDataFrame(steps, "run long, sim_time long, source string, system_time long")
    got = sorted((r.sim_time, r.lag, r.synced) for r in sync.sync_check(df, "run", 2, 100, 10).collect())
    assert got == [(0, 997, True), (100, 997, True)]


def test_gap_measures_never_happened(spark, mode):
    df = spark.createDataFrame([(1, 5, 1, 1.0)], "id long, t long, seq long, v double")
    one = rates.gap_coverage(df, "id", "t", "seq", 3).first()
    assert (one.total, one.pct, one.max_gap, one.n_long) == (None, None, None, 0)
    empty = rates.gap_coverage(df.where("id = 9"), "id", "t", "seq", 3)
    assert empty.count() == 0


def test_gap_exactly_at_the_limit_is_long(spark, mode):
    df = spark.createDataFrame([(1, t, t, 1.0) for t in (0, 2, 5)], "id long, t long, seq long, v double")
    got = rates.gap_coverage(df, "id", "t", "seq", 3).first()
    assert (got.covered, got.total, got.n_long) == (2, 5, 1)


def test_settling_and_sequences(spark, mode):
    df = spark.createDataFrame([(1, t, t, v) for t, v in enumerate([9.0, 1.0, 9.0, 1.0, 1.0])] + [(2, 0, 9, 9.0)], "id long, t long, seq long, v double")
    got = {r.id: (r.begin, r.settled) for r in intervals.settle_time(df, "id", "t", "seq", F.col("v") < 5).collect()}
    assert got == {1: (0, 3), 2: (0, None)}
    seqs = rows_of(intervals.ordered_sequence(df, "id", "t", "seq", "v", [9.0, 1.0, 9.0]), "id", "start", "end")
    assert seqs == [(1, 0, 2)]


def test_samples_in_intervals(spark, mode):
    samples = spark.createDataFrame([(1, t, t) for t in range(12)], "id long, t long, seq long")
    spans = spark.createDataFrame([(1, 2, 4, "a"), (1, 6, 6, "b"), (2, 0, 9, "c")], "id long, start long, end long, name string")
    got = rows_of(intervals.in_intervals(samples, spans, "id", "t", "seq", carry=("name",)).where("name is not null"), "t", "name")
    assert got == [(2, "a"), (3, "a"), (4, "a"), (6, "b")]


def test_track_offset_lays_out_few_offsets(spark):
    """A smooth track, a part of it with noise and gaps: the same offset as by all offsets, from few of them."""
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(0, 1, (3000, 2)) + 0.5, axis=0)
    part = walk[1234:2234] + rng.normal(0, 0.3, (1000, 2))
    rows = lambda points, run: [(run, k, float(x), float(y)) for k, (x, y) in enumerate(points, 1)]
    schema = "id long, i long, x double, y double"
    ref = spark.createDataFrame(rows(walk, 1) + rows(walk[:50], 2), schema)
    odd = [(1, k, None if k % 300 == 0 else x, y) for _, k, x, y in rows(part, 1)]
    sensor = spark.createDataFrame(odd + rows(walk[7:40], 2), schema)
    left = spatial.offset_candidates(ref, sensor, "id", "i").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in left}[1] <= 40
    got = {r.id: (r.offset, round(r.error, 9)) for r in spatial.track_offset(ref, sensor, "id", "i").collect()}
    assert got[1][0] == 1234 and got[2] == (7, 0.0)
    some = ref.where("id = 2"), sensor.where("id = 2")
    every = spatial.offset_search(*some, "id", "i", lambda a, b: F.hypot(a("x") - b("x"), a("y") - b("y"))).first()
    assert (every.offset, round(every.error, 9)) == got[2]


def test_nearest_point_through_levels_of_boxes(spark, monkeypatch):
    """Boxes of two, so that a route of 700 points stands under several levels."""
    monkeypatch.setattr(spatial, "LEAST_BLOCK", 4)
    rng = np.random.default_rng(3)
    path = np.round(np.cumsum(rng.normal(0, 1, (700, 2)), axis=0), 1)
    spots = np.round(rng.normal(0, 15, (60, 2)), 1)
    assert spatial._levels(700, 2) >= 3
    route = spark.createDataFrame([(run, k, float(x), float(y)) for run, n in ((1, 700), (2, 9)) for k, (x, y) in enumerate(path[:n])], "id long, place long, x double, y double")
    points = spark.createDataFrame([(run, k, float(x), float(y)) for run in (1, 2, 3) for k, (x, y) in enumerate(spots)], "id long, seq long, x double, y double")
    got = {(r.id, r.seq): (r.near_place, round(r.near_d, 9)) for r in spatial.nearest_point(points, route, "id", place="place", fan=2).collect()}
    for run, n in ((1, 700), (2, 9)):
        for k, (x, y) in enumerate(spots):
            far = np.hypot(path[:n, 0] - x, path[:n, 1] - y)
            assert got[run, k] == (int(np.argmin(far)), round(float(far.min()), 9))
    assert len(got) == 120


def test_scans_stream_many_small_chunks(spark):
    """A cut log has no Python group per chunk; groups that reach over batches and nulls in keys are whole."""
    rng = random.Random(5)
    rows = [(None if e == 0 else e, t, n, float(rng.randrange(9))) for e in range(12) for n, t in enumerate(sorted(rng.sample(range(400), 90)))]
    df = spark.createDataFrame(rows, "id long, t long, seq long, v double")
    found = lambda out: sorted((r.id is not None, r.id or 0, r.t, r.seq, r.value) for r in out.collect())
    whole = found(hysteresis.hysteresis_changes(df, "id", "t", "seq", "v", 3.0))
    want, last = [], {}
    for e, t, n, v in rows:
        if e not in last or abs(v - last[e]) > 3.0:
            want.append((e is not None, e or 0, t, n, v))
            last[e] = v
    assert whole == sorted(want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        with row_limit(20):
            cut = hysteresis.hysteresis_changes(df, "id", "t", "seq", "v", 3.0)
            assert found(cut) == sorted(want)
            assert "FlatMapGroups" not in cut._jdf.queryExecution().toString()
        assert found(hysteresis.hysteresis_changes(df, "id", "t", "seq", "v", 3.0)) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_splines_stream_many_tracks(spark):
    """Tracks have no Python group each; those that reach over batches give the values of the whole solution."""
    rng = random.Random(8)
    tracks = {e: [(float(k), rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(4 + e)] for e in range(15)}
    df = spark.createDataFrame([(e, t, 0, x, y) for e, rows in tracks.items() for t, x, y in rows], "id long, t double, seq long, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = trajectory.resample_spline(df, "id", "t", "seq", ["x", "y"], 0.5)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        got = {(r.id, r.t): (r.x, r.y) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k[0] for k in got} == {e for e, rows in tracks.items() if len(rows) > 5}
    for e, rows in tracks.items():
        if len(rows) > 5:
            a = np.array(rows)
            span = a[-1, 0]
            at = np.array([0.5 * k for k in range(2 * (len(rows) - 1))])
            values = trajectory.spline_values(a[:, 0] / span, a[:, 1:], at / span, 5)
            assert all(np.allclose(got[e, t], v) for t, v in zip(at.tolist(), values))


def test_track_offset_over_several_tiles(spark, monkeypatch):
    """Small tiles: parts of tracks and of offsets meet over their borders; no row of the search holds a single pair of rows."""
    monkeypatch.setattr(spatial, "TILE", 8)
    rng = np.random.default_rng(8)
    schema, walks = "id long, i long, x double, y double", {None: (61, 40), 1: (64, 8), 2: (9, 8), 3: (8, 8), 4: (50, 1)}
    rows = lambda m: [(run, k, *map(float, rng.normal(0, 5, 2))) for run, sizes in walks.items() for k in range(1, sizes[m] + 1)]
    ref = spark.createDataFrame(rows(0), schema)
    sensor = spark.createDataFrame([(r, k, None if k == 5 else x, y) for r, k, x, y in rows(1)], schema)
    tiles = spatial.Tiles(ref, sensor, "id", "i", None, (4, 2))
    assert tiles.side == 8 and tiles.df.where("id is null").count() == 5 * 3
    got = {r.id: (r.offset, round(r.error, 9)) for r in spatial.track_offset(ref, sensor, "id", "i", blocks=(4, 2)).collect()}
    every = spatial.offset_search(ref, sensor, "id", "i", lambda a, b: F.hypot(a("x") - b("x"), a("y") - b("y")))
    assert got == {r.id: (r.offset, round(r.error, 9)) for r in every.collect()} and set(got) == {None, 1, 2, 4}
