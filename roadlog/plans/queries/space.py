"""Queries of the geometry and trajectory family: x is the event value, y its k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import geo
from ...operators import asof, matching, spatial, trajectory
from ...operators.ordered import Ordered, gridded
from ..registry import DAY, EV, H, load, messages, query

RUN, T, SEQ = ["run_id"], "t", ["seq"]
W = "(PARTITION BY run_id ORDER BY t, seq)"


def _track(spark, sf, topic=None):
    rows = messages(spark, sf)
    if topic:
        rows = rows.where(F.col("topic") == topic)
    return rows.select("run_id", "t", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


def _numbered(df, name):
    return Ordered.of(df, RUN, T, SEQ).number(name).df


_P = f"""{EV}, p AS (SELECT run_id, t, seq, value AS x, CAST(k AS DOUBLE) AS y FROM ev WHERE topic = 'click'),
r AS (SELECT run_id, t, seq, row_number() OVER {W} AS place, value AS x, CAST(k AS DOUBLE) AS y FROM ev WHERE topic = 'view')"""
_NEAR = """d AS (SELECT p.*, r.place, r.x AS rx, r.y AS ry, sqrt((r.x - p.x) ** 2 + (r.y - p.y) ** 2) AS d FROM p JOIN r ON p.run_id = r.run_id),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY seq ORDER BY d, place) = 1)"""


@query("haversine", "c_custkey:i distance:f bearing:f", """
WITH a AS (SELECT c_custkey, 47 + c_acctbal / 100000 AS lat1, -122 - c_nationkey / 100 AS lon1, 47.6 AS lat2, -122.1 AS lon2 FROM customer),
b AS (SELECT *, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS h,
 degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360 AS az FROM a)
SELECT c_custkey, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS distance, az - 360 * floor(az / 360) AS bearing FROM b""")
def haversine(spark, sf):
    lat = F.lit(47.0) + F.col("c_acctbal") / 100000
    lon = F.lit(-122.0) - F.col("c_nationkey") / 100
    return load(spark, sf, "customer").select("c_custkey", geo.haversine(lat, lon, F.lit(47.6), F.lit(-122.1)).alias("distance"),
                                              geo.bearing(lat, lon, F.lit(47.6), F.lit(-122.1)).alias("bearing"))


@query("plane_transforms", "event_id:i lat:f lon:f east:f hx:f hy:f sx:f norm:f", f"""
WITH {EV}, a AS (SELECT seq AS event_id, value AS x, CAST(k AS DOUBLE) AS y FROM ev),
b AS (SELECT *, 47.6 + y / 111111.0 AS lat, -122.1 + x / (111111.0 * cos(radians(47.6))) AS lon, 0.001 * x + 0.002 * y + 1 AS w FROM a)
SELECT event_id, lat, lon, (lon + 122.1) * 111111.0 * cos(radians(47.6)) AS east, (2 * x + 0.5 * y + 3) / w AS hx, (0.1 * x + 1.5 * y - 2) / w AS hy,
 x + (x - 10) * (5.0 / 4.5 - 1) AS sx, sqrt(x * x + y * y + 4) AS norm FROM b""")
def plane_transforms(spark, sf):
    x, y = F.col("x"), F.col("y")
    lat, lon = geo.from_plane(x, y, 47.6, -122.1)
    hx, hy = geo.homography(x, y, [[2, 0.5, 3], [0.1, 1.5, -2], [0.001, 0.002, 1]])
    sx, _ = geo.shadow_point(x, y, 10.0, 0.0, 0.5, 5.0)
    east, _ = geo.to_plane(F.col("lat"), F.col("lon"), 47.6, -122.1)
    rows = _track(spark, sf).withColumnRenamed("seq", "event_id").withColumn("lat", lat).withColumn("lon", lon)
    return rows.select("event_id", "lat", "lon", east.alias("east"), hx.alias("hx"), hy.alias("hy"), sx.alias("sx"), geo.norm3(x, y, F.lit(2.0)).alias("norm"))


@query("nearest_point", "run_id:i seq:i near_place:i near_d:f", f"WITH {_P}, {_NEAR} SELECT run_id, seq, place AS near_place, d AS near_d FROM n")
def nearest_point(spark, sf):
    route = _numbered(_track(spark, sf, "view"), "place").select("run_id", "place", "x", "y")
    return spatial.nearest_point(_track(spark, sf, "click"), route, RUN, place="place")


@query("cross_track", "run_id:i seq:i deviation:f along:f", f"""
WITH {_P}, p0 AS (SELECT *, sqrt((x - lag(x) OVER {W}) ** 2 + (y - lag(y) OVER {W}) ** 2) AS step FROM p),
d AS (SELECT p0.*, r.place, r.x AS rx, r.y AS ry, sqrt((r.x - p0.x) ** 2 + (r.y - p0.y) ** 2) AS d FROM p0 JOIN r ON p0.run_id = r.run_id WHERE step >= 5),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY seq ORDER BY d, place) = 1),
e AS (SELECT run_id, max(place) AS z FROM r GROUP BY run_id),
m AS (SELECT n.* FROM n JOIN e ON n.run_id = e.run_id WHERE place > 1 AND place < z),
s AS (SELECT m.*, (b.x - a.x) * (m.y - a.y) - (b.y - a.y) * (m.x - a.x) AS side FROM m JOIN r a ON a.run_id = m.run_id AND a.place = m.place - 1 JOIN r b ON b.run_id = m.run_id AND b.place = m.place + 1),
q AS (SELECT *, coalesce(sqrt((rx - lag(rx) OVER {W}) ** 2 + (ry - lag(ry) OVER {W}) ** 2), 0) AS ds FROM s)
SELECT run_id, seq, CASE WHEN side > 0 THEN d ELSE -d END AS deviation, sum(ds) OVER {W} AS along FROM q""")
def cross_track(spark, sf):
    route = _numbered(_track(spark, sf, "view"), "place").select("run_id", "place", "x", "y")
    return spatial.cross_track(_track(spark, sf, "click"), route, RUN, T, place="place", tie=SEQ, min_step=5.0)


@query("cross_track_share", "run_id:i n:i pct_inside:f passed:b", f"""
WITH {_P}, {_NEAR} SELECT run_id, count(*) AS n, count(*) FILTER (d < 20) * 100.0 / count(*) AS pct_inside, count(*) FILTER (d < 20) * 100.0 / count(*) > 60 AS passed FROM n GROUP BY run_id""")
def cross_track_share(spark, sf):
    route = _numbered(_track(spark, sf, "view"), "place").select("run_id", "place", "x", "y")
    near = spatial.nearest_point(_track(spark, sf, "click"), route, RUN, place="place")
    share = F.count_if(F.col("near_d") < 20) * 100.0 / F.count(F.lit(1))
    return near.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), share.alias("pct_inside")).withColumn("passed", F.col("pct_inside") > 60)


_SEG = """s{i} AS (SELECT run_id, t AS t1, lead(t) OVER w AS t2, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {src} WINDOW w AS (PARTITION BY run_id ORDER BY t, seq))"""


@query("segment_crossing", "run_id:i t_a:f x:f y:f", f"""
WITH {_P}, {_SEG.format(i='a', src='p')}, {_SEG.format(i='b', src='r')},
c AS (SELECT a.run_id, a.t1, a.t2, a.x1, a.y1, a.x2 - a.x1 AS rx, a.y2 - a.y1 AS ry, b.x2 - b.x1 AS sx, b.y2 - b.y1 AS sy, b.x1 - a.x1 AS qx, b.y1 - a.y1 AS qy
 FROM sa a JOIN sb b ON a.run_id = b.run_id WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL),
d AS (SELECT *, (qx * sy - qy * sx) / nullif(rx * sy - ry * sx, 0) AS u, (qx * ry - qy * rx) / nullif(rx * sy - ry * sx, 0) AS v FROM c)
SELECT run_id, min((t1 + u * (t2 - t1) - 1704067200000000) / {float(H)}) AS t_a, arg_min(x1 + u * rx, t1 + u * (t2 - t1)) AS x, arg_min(y1 + u * ry, t1 + u * (t2 - t1)) AS y
FROM d WHERE u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 GROUP BY run_id""")
def segment_crossing(spark, sf):
    out = spatial.conflict_point(_track(spark, sf, "click"), _track(spark, sf, "view"), RUN, T, 50.0, SEQ)
    return out.withColumn("t_a", (F.col("t_a") - F.lit(1704067200000000)) / F.lit(float(H)))


_OFFSETS = f"""
WITH {_P}, a AS (SELECT run_id, row_number() OVER {W} AS i, value AS x, CAST(k AS DOUBLE) AS y FROM ev WHERE topic <> 'view'),
n AS (SELECT r.run_id, m - count(*) AS room FROM r JOIN (SELECT run_id, count(*) AS m FROM a GROUP BY run_id) c ON r.run_id = c.run_id GROUP BY r.run_id, m),
o AS (SELECT run_id, unnest(range(0, greatest(room, 0))) AS shift FROM n),
e AS (SELECT o.run_id, o.shift, avg(sqrt((a.x - r.x) ** 2 + (a.y - r.y) ** 2)) AS error FROM o JOIN r ON r.run_id = o.run_id JOIN a ON a.run_id = o.run_id AND a.i = r.place + o.shift GROUP BY ALL)
SELECT run_id, shift, error FROM e QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY error, shift) = 1"""


@query("offset_search", "run_id:i shift:i error:f", _OFFSETS)
def offset_search(spark, sf):
    rows = messages(spark, sf).where("topic <> 'view'")
    ref = _numbered(rows.select("run_id", "t", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y")), "i").select("run_id", "i", "x", "y")
    sensor = _numbered(_track(spark, sf, "view"), "i").select("run_id", "i", "x", "y")
    return spatial.offset_search(ref, sensor, RUN, "i", lambda a, b: F.hypot(a("x") - b("x"), a("y") - b("y"))).withColumnRenamed("offset", "shift")


@query("track_offset", "run_id:i shift:i error:f", _OFFSETS)
def track_offset(spark, sf):
    rows = messages(spark, sf).where("topic <> 'view'")
    ref = _numbered(rows.select("run_id", "t", "seq", F.col("value").alias("x"), F.col("k").cast("double").alias("y")), "i").select("run_id", "i", "x", "y")
    sensor = _numbered(_track(spark, sf, "view"), "i").select("run_id", "i", "x", "y")
    return spatial.track_offset(ref, sensor, RUN, "i", blocks=(4, 2)).withColumnRenamed("offset", "shift")


@query("densify", "run_id:i place:i sample:i x:f y:f", f"""
WITH {_P}, l AS (SELECT run_id, place, lag(x) OVER w AS px, lag(y) OVER w AS py, x, y FROM r WINDOW w AS (PARTITION BY run_id ORDER BY place)), s AS (SELECT unnest(range(1, 9)) AS sample)
SELECT run_id, place, sample, (1 - sample / 9.0) * px + sample / 9.0 * x AS x, (1 - sample / 9.0) * py + sample / 9.0 * y AS y FROM l, s WHERE px IS NOT NULL""")
def densify(spark, sf):
    route = _numbered(_track(spark, sf, "view"), "place").select("run_id", "place", "x", "y")
    return spatial.densify(route, RUN, "place", 10)


_RS = f"""{EV}, e AS (SELECT run_id, t, seq, value AS x, CAST(k AS DOUBLE) AS y FROM ev WHERE topic = 'COND'),
l AS (SELECT run_id, t, x, y, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, max(t) OVER (PARTITION BY run_id) AS z FROM e WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)),
g AS (SELECT *, unnest(range((t + {DAY} - 1) // {DAY}, least((nt + {DAY} - 1) // {DAY}, z // {DAY}))) * {DAY} AS gt FROM l WHERE nt > t)"""


@query("resample_linear", "run_id:i t:i x:f y:f", f"""
WITH {_RS.replace('COND', 'view')} SELECT run_id, gt AS t, x + (nx - x) * ((gt - t) / (nt - t)) AS x, y + (ny - y) * ((gt - t) / (nt - t)) AS y FROM g""")
def resample_linear(spark, sf):
    return trajectory.resample_linear(_track(spark, sf, "view"), RUN, T, SEQ, ["x", "y"], DAY)


@query("track_error", "run_id:i n:i mean_error:f pct_under:f", f"""
WITH {EV}, e AS (SELECT run_id, topic, t, seq, value AS x, CAST(k AS DOUBLE) AS y FROM ev WHERE topic IN ('view', 'click')),
l AS (SELECT run_id, topic, t, x, y, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, max(t) OVER (PARTITION BY run_id, topic) AS z FROM e WINDOW w AS (PARTITION BY run_id, topic ORDER BY t, seq)),
g AS (SELECT *, unnest(range((t + {DAY} - 1) // {DAY}, least((nt + {DAY} - 1) // {DAY}, z // {DAY}))) * {DAY} AS gt FROM l WHERE nt > t),
v AS (SELECT run_id, topic, gt, x + (nx - x) * ((gt - t) / (nt - t)) AS x, y + (ny - y) * ((gt - t) / (nt - t)) AS y FROM g),
j AS (SELECT a.run_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS err FROM v a JOIN v b ON a.run_id = b.run_id AND a.gt = b.gt WHERE a.topic = 'click' AND b.topic = 'view')
SELECT run_id, count(*) AS n, avg(err) AS mean_error, count(*) FILTER (err < 50) * 100.0 / count(*) AS pct_under FROM j GROUP BY run_id""")
def track_error(spark, sf):
    errors = trajectory.track_error(_track(spark, sf, "click"), _track(spark, sf, "view"), RUN, T, SEQ, DAY)
    return errors.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"),
                                        (F.count_if(F.col("error") < 50) * 100.0 / F.count(F.lit(1))).alias("pct_under"))


@query("interpolate_at", "run_id:i seq:i x:f y:f", f"""
WITH {_P}, b AS (SELECT p.run_id, p.t, p.seq, r.t AS bt, r.x AS bx, r.y AS by_ FROM p ASOF JOIN r ON p.run_id = r.run_id AND p.t >= r.t),
f AS (SELECT b.*, r.t AS ft, r.x AS fx, r.y AS fy FROM b ASOF JOIN r ON b.run_id = r.run_id AND b.t <= r.t)
SELECT run_id, seq, bx + (fx - bx) * coalesce((t - bt) / nullif(ft - bt, 0), 0) AS x, by_ + (fy - by_) * coalesce((t - bt) / nullif(ft - bt, 0), 0) AS y FROM f""")
def interpolate_at(spark, sf):
    times = _track(spark, sf, "click").select("run_id", "t", "seq")
    return trajectory.interpolate_at(_track(spark, sf, "view"), times, RUN, T, ["x", "y"], tie=SEQ)


@query("spline_resample", "run_id:i t:f x:f y:f")
def spline_resample(spark, sf):
    track = _track(spark, sf).withColumn("t", (F.col("t") - F.lit(1704067200000000)) / F.lit(float(H)))
    return trajectory.resample_spline(track, RUN, T, SEQ, ["x", "y"], 6.0)


@query("zone_times", "run_id:i t_enter:i t_exit:i", f"""
WITH {_RS.replace('COND', 'view')}, a AS (SELECT run_id, gt, x + (nx - x) * ((gt - t) / (nt - t)) AS x FROM g),
e1 AS (SELECT run_id, min(gt) FILTER (x < 30) AS t_enter FROM a GROUP BY run_id)
SELECT run_id, any_value(t_enter) AS t_enter, min(gt) FILTER (NOT x < 30 AND gt > t_enter) AS t_exit FROM a JOIN e1 USING (run_id) GROUP BY run_id""")
def zone_times(spark, sf):
    track = _track(spark, sf, "view")
    even = trajectory.resample_linear(track, RUN, T, SEQ, ["x", "y"], DAY)
    with gridded(track, RUN, T, DAY):
        return trajectory.zone_times(even, RUN, "t", (), F.col("x") < 30)


@query("compass_crossing", "run_id:i direction:s t_cross:i", f"""
WITH {EV}, a AS (SELECT run_id, t, value >= 60 AS e, value <= 60 AS w, k >= 70 AS n, k <= 30 AS s FROM ev)
SELECT run_id, 'N' AS direction, min(t) FILTER (k >= 60) AS t_cross FROM ev GROUP BY run_id UNION ALL SELECT run_id, 'S', min(t) FILTER (k <= 60) FROM ev GROUP BY run_id
UNION ALL SELECT run_id, 'E', min(t) FILTER (value >= 60) FROM ev GROUP BY run_id UNION ALL SELECT run_id, 'W', min(t) FILTER (value <= 60) FROM ev GROUP BY run_id
UNION ALL SELECT run_id, 'NE', min(t) FILTER (k >= 60 AND value >= 60) FROM ev GROUP BY run_id UNION ALL SELECT run_id, 'SE', min(t) FILTER (k <= 60 AND value >= 60) FROM ev GROUP BY run_id
UNION ALL SELECT run_id, 'SW', min(t) FILTER (k <= 60 AND value <= 60) FROM ev GROUP BY run_id UNION ALL SELECT run_id, 'NW', min(t) FILTER (k >= 60 AND value <= 60) FROM ev GROUP BY run_id""")
def compass_crossing(spark, sf):
    return trajectory.crossings(_track(spark, sf), RUN, T, 60.0, 60.0)


@query("max_speed", "run_id:i max_speed:f", f"""
WITH {EV}, a AS (SELECT run_id, sqrt((value - lag(value) OVER {W}) ** 2 + (k - lag(k) OVER {W}) ** 2) / ((t - lag(t) OVER {W}) / {float(H)}) AS v FROM ev) SELECT run_id, least(max(v), 500) AS max_speed FROM a GROUP BY run_id""")
def max_speed(spark, sf):
    return trajectory.max_speed(_track(spark, sf), RUN, T, SEQ, H, 500.0)


@query("conflict_scan", "run_id:i seq:i ttc:f", f"""
WITH {_P}, o AS (SELECT *, x / 50.0 AS v, coalesce(sqrt((x - lag(x) OVER {W}) ** 2 + (y - lag(y) OVER {W}) ** 2), 0) AS step, row_number() OVER {W} AS i FROM p),
q AS (SELECT *, sum(step) OVER {W} AS s FROM o), a AS (SELECT x.run_id, x.seq, x.t, (y.s - x.s) / x.v * {float(H)} AS travel, y.x AS px, y.y AS py
 FROM q x JOIN q y ON x.run_id = y.run_id AND y.i > x.i WHERE x.v >= 0.01 AND y.step > 0),
l AS (SELECT run_id, t, lead(t) OVER w AS nt, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM r WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)),
m AS (SELECT a.*, l.x + (l.nx - l.x) * ((a.t + travel - l.t) / (l.nt - l.t)) AS ox, l.y + (l.ny - l.y) * ((a.t + travel - l.t) / (l.nt - l.t)) AS oy
 FROM a JOIN l ON a.run_id = l.run_id AND a.t + travel > l.t AND a.t + travel < l.nt),
h AS (SELECT run_id, seq, min(travel) AS ttc FROM m WHERE sqrt((ox - px) ** 2 + (oy - py) ** 2) < 15 GROUP BY ALL
 UNION ALL SELECT q.run_id, q.seq, 0 FROM q JOIN l ON q.run_id = l.run_id AND q.t >= l.t AND q.t <= l.nt WHERE abs(v) < 0.01
 AND sqrt((l.x + (l.nx - l.x) * ((q.t - l.t) / (l.nt - l.t)) - q.x) ** 2 + (l.y + (l.ny - l.y) * ((q.t - l.t) / (l.nt - l.t)) - q.y) ** 2) < 15)
SELECT q.run_id, q.seq, h.ttc / {float(H)} AS ttc FROM q LEFT JOIN h ON q.seq = h.seq""")
def conflict_scan(spark, sf):
    own = _track(spark, sf, "click").withColumn("v", F.col("x") / 50.0)
    out = spatial.conflict_scan(own, _track(spark, sf, "view"), RUN, T, 15.0, unit=float(H), tie=SEQ)
    return out.withColumn("ttc", F.col("ttc") / F.lit(float(H)))


@query("path_driven", "run_id:i t:i src:i dst:i hops:i via:s", f"""
WITH {EV}, v AS (SELECT run_id, t, seq, k // 10 AS node, lag(k // 10) OVER {W} AS p FROM ev), c AS (SELECT run_id, t, seq, node FROM v WHERE p IS DISTINCT FROM node),
s AS (SELECT run_id, t, lag(node) OVER {W} AS src, node AS dst FROM c), e AS (SELECT DISTINCT s_nationkey % 10 AS src, (s_nationkey % 10 + 1 + s_suppkey % 2 * 3) % 10 AS dst FROM supplier),
w AS (SELECT src, dst, 1 AS hops, '' AS via FROM e UNION ALL SELECT a.src, b.dst, 2, CAST(a.dst AS VARCHAR) FROM e a JOIN e b ON a.dst = b.src
 UNION ALL SELECT a.src, c.dst, 3, a.dst || '-' || b.dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src),
z AS (SELECT src, dst, hops, via FROM w QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY hops, via) = 1)
SELECT run_id, t, s.src, s.dst, hops, via FROM s LEFT JOIN z ON z.src = s.src AND z.dst = s.dst WHERE s.src IS NOT NULL""")
def path_driven(spark, sf):
    visits = messages(spark, sf).select("run_id", "t", "seq", F.floor(F.col("k") / 10).alias("node"))
    here = F.col("s_nationkey").cast("long") % 10
    edges = load(spark, sf, "supplier").select(here.alias("src"), ((here + 1 + F.col("s_suppkey") % 2 * 3) % 10).alias("dst"))
    return spatial.path_driven(visits, edges, RUN, T, SEQ, "node").withColumn("via", F.concat_ws("-", "via")).withColumn(
        "via", F.when(F.col("hops").isNotNull(), F.col("via")))


@query("path_reached", "run_id:i t:i src:i dst:i hops:i via:s", f"""
WITH RECURSIVE {EV}, v AS (SELECT run_id, t, seq, k // 10 AS node, lag(k // 10) OVER {W} AS p FROM ev), c AS (SELECT run_id, t, node, row_number() OVER {W} AS n FROM v WHERE p IS DISTINCT FROM node),
e AS (SELECT DISTINCT src, dst FROM (SELECT s_nationkey % 10 AS src, (s_nationkey % 10 + 1 + CASE WHEN s_nationkey % 10 < 4 THEN s_suppkey % 2 ELSE 0 END) % 10 AS dst FROM supplier) WHERE src <> dst),
w AS (SELECT src, count(*) > 1 AS branch FROM e GROUP BY src), e2 AS (SELECT a.src, a.dst AS m, b.dst FROM e a JOIN e b ON a.dst = b.src), near AS (SELECT src, dst FROM e UNION SELECT src, dst FROM e2),
far AS (SELECT a.src, b.dst, min((a.m, a.dst)) AS w FROM e2 a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM near WHERE near.src = a.src AND near.dst = b.dst) GROUP BY a.src, b.dst),
x AS (SELECT run_id, n, t, node, coalesce(branch, false) AS branch FROM c LEFT JOIN w ON w.src = c.node),
z AS (SELECT run_id, n, t, node AS at_, branch AS waits, NULL::BIGINT AS src, NULL::INTEGER AS hops, NULL::VARCHAR AS via FROM x WHERE n = 1
 UNION ALL SELECT x.run_id, x.n, x.t, CASE WHEN e.dst IS NOT NULL OR far.dst IS NOT NULL THEN x.node ELSE z.at_ END, CASE WHEN e.dst IS NOT NULL THEN x.branch WHEN far.dst IS NOT NULL THEN false ELSE z.waits END,
 CASE WHEN e.dst IS NOT NULL OR far.dst IS NOT NULL THEN z.at_ END, CASE WHEN e.dst IS NOT NULL THEN 1 WHEN far.dst IS NOT NULL THEN 3 END,
 CASE WHEN e.dst IS NOT NULL THEN '' WHEN far.dst IS NOT NULL THEN far.w[1] || '-' || far.w[2] END
 FROM z JOIN x ON x.run_id = z.run_id AND x.n = z.n + 1 LEFT JOIN e ON NOT z.waits AND e.src = z.at_ AND e.dst = x.node LEFT JOIN far ON z.waits AND far.src = z.at_ AND far.dst = x.node)
SELECT run_id, t, src, at_ AS dst, hops, via FROM z WHERE src IS NOT NULL""")
def path_reached(spark, sf):
    visits = messages(spark, sf).select("run_id", "t", "seq", F.floor(F.col("k") / 10).alias("node"))
    here = F.col("s_nationkey").cast("long") % 10
    # the first nodes of the ring have two ways on
    skip = F.when(here < 4, F.col("s_suppkey") % 2).otherwise(0)
    edges = load(spark, sf, "supplier").select(here.alias("src"), ((here + 1 + skip) % 10).cast("long").alias("dst"))
    return spatial.path_reached(visits, edges, RUN, T, SEQ, "node")


@query("azimuth", "c_custkey:i azimuth:f", """
WITH a AS (SELECT c_custkey, radians(47 + c_acctbal / 100000) AS a, radians(47.6) AS b, radians(-122.1 - (-122 - c_nationkey / 100)) AS l, (1 / 298.257223563) * (2 - 1 / 298.257223563) AS e2 FROM customer),
n AS (SELECT *, 1 / sqrt(1 - e2 * sin(a) * sin(a)) AS n1, 1 / sqrt(1 - e2 * sin(b) * sin(b)) AS n2 FROM a),
u AS (SELECT *, n2 * cos(b) * cos(l) - n1 * cos(a) AS across, (1 - e2) * (n2 * sin(b) - n1 * sin(a)) AS up FROM n),
z AS (SELECT c_custkey, degrees(atan2(n2 * cos(b) * sin(l), cos(a) * up - sin(a) * across)) + 360 AS az FROM u) SELECT c_custkey, az - 360 * floor(az / 360) AS azimuth FROM z""")
def azimuth(spark, sf):
    lat = F.lit(47.0) + F.col("c_acctbal") / 100000
    lon = F.lit(-122.0) - F.col("c_nationkey") / 100
    return load(spark, sf, "customer").select("c_custkey", geo.azimuth(lat, lon, F.lit(47.6), F.lit(-122.1)).alias("azimuth"))


@query("merge_distance", "l_orderkey:i x:f y:f feet:f", """
WITH a AS (SELECT l_orderkey, row_number() OVER w AS n, epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 1e6 AS t, l_quantity AS x, CAST(l_linenumber AS DOUBLE) AS y, l_returnflag <> 'N' AS m FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)),
b AS (SELECT *, lag(t) OVER (PARTITION BY l_orderkey ORDER BY n) AS pt, lead(t) OVER (PARTITION BY l_orderkey ORDER BY n) AS nt, lead(m) OVER (PARTITION BY l_orderkey ORDER BY n) AS nm FROM a),
c AS (SELECT * FROM b WHERE m AND ((NOT nm AND nt - t > 0.001) OR (nt IS NULL AND t - pt > 0.001)) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n) = 1)
SELECT l_orderkey, x, y, sqrt((x - 25) ** 2 + (y - 3) ** 2) * 3.28 AS feet FROM c""")
def merge_distance(spark, sf):
    # the lines of an order as the points of a planned trajectory, returned lines as those of the merging planner
    points = load(spark, sf, "lineitem").select(
        "l_orderkey", (F.unix_micros(F.to_utc_timestamp(F.col("l_shipdate").cast("timestamp"), F.current_timezone())) / 1e6).alias("t"), "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("double").alias("x"), "l_returnflag", F.col("l_linenumber").cast("double").alias("y"))
    return trajectory.merge_distance(points, "l_orderkey", "t", ["l_linenumber", "l_partkey", "l_suppkey", "x", "l_returnflag"], "l_returnflag", ["A", "R"], (25.0, 3.0))


@query("spline_by_length", "run_id:i s:f x:f y:f")
def spline_by_length(spark, sf):
    return trajectory.resample_by_length(_track(spark, sf, "view"), RUN, T, SEQ, 25.0)


@query("runs_by_speed", "n_nationkey:i c_custkey:i place:i", """
SELECT c_nationkey AS n_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place FROM customer""")
def runs_by_speed(spark, sf):
    from ...operators.reshape import rank_in

    # customers of a nation as the runs of a vehicle, their balance as the speed
    runs = load(spark, sf, "customer")
    return runs.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", rank_in("c_nationkey", "c_acctbal", "c_custkey").alias("place"))


@query("stop_location", "run_id:i t_stop:i distance:f passed:b", f"""
WITH {EV}, s AS (SELECT run_id, min(t) AS t_stop FROM ev WHERE value < 3 GROUP BY run_id), p AS (SELECT run_id, t, value, k FROM ev WHERE topic = 'view')
SELECT s.run_id, t_stop, sqrt((p.value - 50) ** 2 + (p.k - 50) ** 2) - 5 AS distance, sqrt((p.value - 50) ** 2 + (p.k - 50) ** 2) - 5 <= 40 AS passed
FROM s ASOF LEFT JOIN p ON s.run_id = p.run_id AND s.t_stop <= p.t""")
def stop_location(spark, sf):
    rows = messages(spark, sf)
    stops = rows.where("value < 3").groupBy("run_id").agg(F.min("t").alias("t"))
    pose = _track(spark, sf, "view")
    at = asof.asof_join(stops, pose, RUN, T, direction="forward", right_tie=SEQ, columns=["x", "y"])
    distance = geo.distance(F.col("x"), F.col("y"), F.lit(50.0), F.lit(50.0)) - 5
    return at.withColumnRenamed("t", "t_stop").withColumn("distance", distance).withColumn("passed", F.col("distance") <= 40)


@query("vehicle_gap", "leader:i follower:i seq:i gap:f cross_gap:f headway:f", f"""
WITH {EV}, a AS (SELECT * FROM ev WHERE topic = 'click'), f AS (SELECT run_id - 1 AS leader, t, seq, value, k FROM ev WHERE topic = 'click')
SELECT a.run_id AS leader, a.run_id + 1 AS follower, a.seq, a.value - f.value AS gap, abs(a.k - f.k) AS cross_gap, (a.value - f.value) / nullif(f.value, 0) AS headway
FROM a ASOF LEFT JOIN f ON f.leader = a.run_id AND a.t <= f.t""")
def vehicle_gap(spark, sf):
    rows = messages(spark, sf).where("topic = 'click'")
    leader = rows.select(F.col("run_id").alias("leader"), "t", "seq", "value", "k")
    follower = rows.select((F.col("run_id") - 1).alias("leader"), "t", F.col("seq").alias("f_seq"), F.col("value").alias("f_value"), F.col("k").alias("f_k"))
    joined = matching.next_after(leader, follower, "leader", T, tie="f_seq", columns=["f_value", "f_k"])
    gap = F.col("value") - F.col("f_value")
    return joined.select("leader", (F.col("leader") + 1).alias("follower"), "seq", gap.alias("gap"), F.abs(F.col("k") - F.col("f_k")).alias("cross_gap"),
                         F.try_divide(gap, F.col("f_value")).alias("headway"))


@query("planner_change", "l_orderkey:i place:i quantity:f following:s", """
WITH a AS (SELECT l_orderkey, row_number() OVER w - 1 AS place, l_quantity, l_returnflag, lead(l_returnflag) OVER w AS following FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_returnflag))
SELECT l_orderkey, min(place) AS place, arg_min(l_quantity, place) AS quantity, arg_min(following, place) AS following FROM a WHERE following <> l_returnflag GROUP BY l_orderkey""")
def planner_change(spark, sf):
    # the lines of an order as the points of a trajectory; where the planner of the points changes
    points = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    o = Ordered.of(points, "l_orderkey", "l_linenumber", ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])
    steps = o.number("n").next(following="l_returnflag").df.withColumn("place", F.col("n") - 1)
    changed = steps.where(F.col("following") != F.col("l_returnflag"))
    return changed.groupBy("l_orderkey").agg(F.min("place").alias("place"), F.min_by("l_quantity", "place").alias("quantity"),
                                             F.min_by("following", "place").alias("following"))


@query("localisation_spread", "run_id:i seq:i spread:f along:f", f"""
WITH {EV}, c AS (SELECT run_id, t, seq, CAST(k AS DOUBLE) AS k, value FROM ev WHERE topic = 'click'),
w AS (SELECT run_id, t, seq, [value, value + k / 10, value - 3] AS ps, [1.0, 2.0 + k, 3.0] AS ws FROM c),
x AS (SELECT run_id, t, seq, unnest(ps) AS v, unnest(ws) AS w FROM w),
s AS (SELECT run_id, t, seq, sqrt((sum(w * v * v) - sum(w * v) ** 2 / sum(w)) / (sum(w) - sum(w * w) / sum(w))) AS spread FROM x GROUP BY ALL),
r AS (SELECT run_id, t, seq, value AS x, CAST(k AS DOUBLE) AS y FROM ev WHERE topic = 'view'),
l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER {W}) ** 2 + (y - lag(y) OVER {W}) ** 2), 0) AS step FROM r), d AS (SELECT *, sum(step) OVER {W} AS along FROM l)
SELECT s.run_id, s.seq, spread, d.along FROM s ASOF JOIN d ON s.run_id = d.run_id AND s.t >= d.t""")
def localisation_spread(spark, sf):
    from ...operators.rolling import path_length
    from ...operators.stats import weighted_spread

    rows = messages(spark, sf).where("topic = 'click'")
    v, k = F.col("value"), F.col("k").cast("double")
    cloud = F.array(F.struct(v.alias("x"), F.lit(1.0).alias("w")), F.struct((v + k / 10).alias("x"), (k + 2.0).alias("w")), F.struct((v - 3).alias("x"), F.lit(3.0).alias("w")))
    particles = rows.select("run_id", "t", "seq", F.inline(cloud))
    spread = weighted_spread(particles, ["run_id", "t", "seq"], "x", "w").withColumnRenamed("sd", "spread")
    driven = path_length(_track(spark, sf, "view"), RUN, T, SEQ, "x", "y", name="along").select("run_id", "t", "seq", "along")
    return asof.asof_join(spread, driven, RUN, T, right_tie=SEQ, columns=["along"]).where(F.col("along").isNotNull())


@query("encroachment", "run_id:i vehicle_enter:f walker_exit:f pet:f distance:f expected_pet:f")
def encroachment(spark, sf):
    hours = lambda topic: _track(spark, sf, topic).withColumn("t", (F.col("t") - F.lit(1704067200000000)) / F.lit(float(H)))
    return trajectory.encroachment(hours("click"), hours("view"), RUN, T, SEQ, zone=10.0, cell=50.0, enter_step=0.5, exit_step=1.0, accel=3.0,
                                   top_speed=13.41, buffer=3.0, unit=1.0)


@query("sensor_accuracy", "run_id:i measure:s mean:f sd:f pct_under:f passed:b", f"""
WITH {EV}, e AS (SELECT run_id, topic, t, seq, value AS x, CAST(k AS DOUBLE) AS y, value / 10 AS speed FROM ev WHERE topic IN ('view', 'click')),
l AS (SELECT *, lead(t) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(speed) OVER w AS ns, max(t) OVER (PARTITION BY run_id, topic) AS z FROM e WINDOW w AS (PARTITION BY run_id, topic ORDER BY t, seq)),
g AS (SELECT *, unnest(range((t + {DAY} - 1) // {DAY}, least((nt + {DAY} - 1) // {DAY}, z // {DAY}))) * {DAY} AS gt FROM l WHERE nt > t),
v AS (SELECT run_id, topic, row_number() OVER (PARTITION BY run_id, topic ORDER BY gt) AS i, x + (nx - x) * ((gt - t) / (nt - t)) AS x, y + (ny - y) * ((gt - t) / (nt - t)) AS y,
 speed + (ns - speed) * ((gt - t) / (nt - t)) AS speed FROM g),
n AS (SELECT a.run_id, na - ns AS room FROM (SELECT run_id, count(*) AS na FROM v WHERE topic = 'view' GROUP BY run_id) a JOIN (SELECT run_id, count(*) AS ns FROM v WHERE topic = 'click' GROUP BY run_id) b USING (run_id)),
o AS (SELECT run_id, unnest(range(0, greatest(room, 0))) AS shift FROM n),
m AS (SELECT o.run_id, o.shift, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS err FROM o JOIN v b ON b.run_id = o.run_id AND b.topic = 'click' JOIN v a ON a.run_id = o.run_id AND a.topic = 'view' AND a.i = b.i + o.shift GROUP BY ALL),
best AS (SELECT run_id, shift FROM m QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY err, shift) = 1),
j AS (SELECT b.run_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS p, abs(a.speed - b.speed) * 2.23694 AS s FROM best JOIN v b ON b.run_id = best.run_id AND b.topic = 'click' JOIN v a ON a.run_id = b.run_id AND a.topic = 'view' AND a.i = b.i + shift)
SELECT run_id, 'position' AS measure, avg(p) AS mean, stddev_pop(p) AS sd, count(*) FILTER (p < 40) * 100.0 / count(*) AS pct_under, count(*) FILTER (p < 40) * 100.0 / count(*) >= 50 AS passed FROM j GROUP BY run_id
UNION ALL SELECT run_id, 'speed', avg(s), stddev_pop(s), count(*) FILTER (s < 8) * 100.0 / count(*), count(*) FILTER (s < 8) * 100.0 / count(*) >= 50 FROM j GROUP BY run_id
UNION ALL SELECT run_id, 'heading', 0, 0, 100, true FROM j GROUP BY run_id""")
def sensor_accuracy(spark, sf):
    from .. import sensor

    track = lambda topic: _track(spark, sf, topic).withColumn("speed", F.col("x") / 10).withColumn("heading", F.lit(90.0))
    matched = sensor.matched_tracks(track("click"), track("view"), RUN, T, SEQ, DAY)
    return sensor.accuracy(matched, RUN, limits=(40.0, 8.0, 3.0), share=50.0)


@query("sensor_confidence", "l_returnflag:s mean:f pct_tracks:f passed:b", """
WITH a AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) AS m, count(*) FILTER (l_quantity > 5) * 100.0 / count(*) AS p FROM lineitem GROUP BY ALL)
SELECT l_returnflag, avg(m) AS mean, count(*) FILTER (p > 90) * 100.0 / count(*) AS pct_tracks, count(*) FILTER (p > 90) * 100.0 / count(*) >= 50 AS passed FROM a GROUP BY ALL""")
def sensor_confidence(spark, sf):
    from .. import sensor

    lines = load(spark, sf, "lineitem")
    out = sensor.confidence(lines, "l_suppkey", "l_returnflag", "l_quantity", least=5)
    return out.withColumn("passed", F.col("pct_tracks") >= 50)
