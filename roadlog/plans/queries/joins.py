"""Queries of the join family: as-of, pairing, chains, lookups, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import asof, intervals, matching, quality, reshape, stats
from ..registry import DAY, EV, H, ORACLES, load, messages, query

RUN, T, SEQ = ["run_id"], "t", ["seq"]
W = "(PARTITION BY run_id ORDER BY t, seq)"


def _topic(df, name):
    return df.where(F.col("topic") == name)


def _sides(spark, sf):
    rows = messages(spark, sf)
    left = _topic(rows, "click").select("run_id", "t", "seq")
    right = _topic(rows, "view").select("run_id", "t", "seq", F.col("seq").alias("r_seq"), F.col("value").alias("r_value"))
    return left, right


_SIDES = f"""{EV}, l AS (SELECT run_id, t, seq FROM ev WHERE topic = 'click'),
r AS (SELECT run_id, t, seq AS r_seq, value AS r_value FROM ev WHERE topic = 'view')"""
_BACK = "run_id:i seq:i r_seq:i r_value:f"


@query("asof_backward", _BACK, f"WITH {_SIDES} SELECT l.run_id, l.seq, r_seq, r_value FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t >= r.t")
def asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    return asof.asof_join(left, right, RUN, T, right_tie=SEQ, columns=["r_seq", "r_value"])


@query("asof_forward", _BACK, f"WITH {_SIDES} SELECT l.run_id, l.seq, r_seq, r_value FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t <= r.t")
def asof_forward(spark, sf):
    left, right = _sides(spark, sf)
    return asof.asof_join(left, right, RUN, T, direction="forward", right_tie=SEQ, columns=["r_seq", "r_value"])


@query("asof_forward_strict", "run_id:i d:i seq:i r_d:i", f"""
WITH {EV}, l AS (SELECT run_id, t // {DAY} AS d, seq FROM ev WHERE topic = 'click'), r AS (SELECT DISTINCT run_id, t // {DAY} AS d FROM ev WHERE topic = 'view')
SELECT l.run_id, l.d, seq, r.d AS r_d FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.d < r.d""")
def asof_forward_strict(spark, sf):
    rows = messages(spark, sf).withColumn("d", F.floor(F.col("t") / F.lit(DAY)))
    right = _topic(rows, "view").select("run_id", "d").distinct().withColumn("r_d", F.col("d"))
    return asof.clock_at(_topic(rows, "click").select("run_id", "d", "seq"), right, RUN, "d", "r_d", rule="next")


@query("asof_backward_strict", "run_id:i d:i seq:i r_d:i", f"""
WITH {EV}, l AS (SELECT run_id, t // {DAY} AS d, seq FROM ev WHERE topic = 'click'), r AS (SELECT DISTINCT run_id, t // {DAY} AS d FROM ev WHERE topic = 'view')
SELECT l.run_id, l.d, seq, r.d AS r_d FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.d > r.d""")
def asof_backward_strict(spark, sf):
    rows = messages(spark, sf).withColumn("d", F.floor(F.col("t") / F.lit(DAY)))
    right = _topic(rows, "view").select("run_id", "d").distinct().withColumn("r_d", F.col("d"))
    return asof.asof_join(_topic(rows, "click").select("run_id", "d", "seq"), right, RUN, "d", allow_exact=False, columns=["r_d"])


@query("asof_nearest", "run_id:i seq:i r_seq:i", f"""
WITH {_SIDES}, b AS (SELECT l.run_id, l.t, l.seq, r.t AS bt, r_seq AS bs FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t >= r.t),
f AS (SELECT l.seq, r.t AS ft, r_seq AS fs FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t <= r.t)
SELECT run_id, seq, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR t - bt < ft - t) THEN bs ELSE fs END AS r_seq FROM b JOIN f USING (seq)""")
def asof_nearest(spark, sf):
    left, right = _sides(spark, sf)
    return asof.asof_join(left, right, RUN, T, direction="nearest", right_tie=SEQ, columns=["r_seq"])


@query("asof_tolerance", _BACK, f"""
WITH {_SIDES} SELECT l.run_id, l.seq, CASE WHEN l.t - r.t <= {6*H} THEN r_seq END AS r_seq, CASE WHEN l.t - r.t <= {6*H} THEN r_value END AS r_value
FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t >= r.t""")
def asof_tolerance(spark, sf):
    left, right = _sides(spark, sf)
    return asof.asof_join(left, right, RUN, T, right_tie=SEQ, columns=["r_seq", "r_value"], tolerance=6 * H)


@query("last_known_merge", "run_id:i seq:i value:f target:f", f"""
WITH {EV}, r AS (SELECT run_id, t, value AS target FROM ev WHERE topic = 'view')
SELECT l.run_id, l.seq, l.value, coalesce(r.target, 0) AS target FROM (SELECT * FROM ev WHERE topic <> 'view') l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.t >= r.t""")
def last_known_merge(spark, sf):
    rows = messages(spark, sf)
    state = _topic(rows, "view").select("run_id", "t", "seq", F.col("value").alias("target"))
    return asof.last_known(rows.where(F.col("topic") != "view"), state, RUN, T, ["target"], tie=SEQ, default=0.0)


@query("orders_asof_shipment", "o_custkey:i o_orderkey:i t:i previous_order:i", """
WITH a AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS t FROM orders),
b AS (SELECT o_custkey, t, max(o_orderkey) AS previous_order FROM a GROUP BY ALL)
SELECT a.o_custkey, a.o_orderkey, a.t, b.previous_order FROM a ASOF LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.t > b.t""")
def orders_asof_shipment(spark, sf):
    from ..registry import micros

    rows = load(spark, sf, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("t"))
    right = rows.withColumn("previous_order", F.col("o_orderkey"))
    return asof.asof_join(rows, right, "o_custkey", T, allow_exact=False, right_tie="o_orderkey", columns=["previous_order"])


_QUEUE = """c AS (SELECT *, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER w AS s, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) OVER w AS g FROM b WINDOW w AS (PARTITION BY {key} ORDER BY t, side, seq)),
d AS (SELECT *, greatest(0, max(g - s) OVER (PARTITION BY {key} ORDER BY t, side, seq)) AS u FROM c),
e AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY {key} ORDER BY t, side, seq), 0) AS pu FROM d)"""


@query("ordinal_pairing", "run_id:i ordinal:i t_call:i t_response:i delay:f", f"""
WITH {EV}, b AS (SELECT run_id, t, seq, CASE topic WHEN 'click' THEN 0 ELSE 1 END AS side FROM ev WHERE topic IN ('click', 'purchase')), {_QUEUE.format(key="run_id")},
x AS (SELECT run_id, s AS ordinal, t AS t_call FROM e WHERE side = 0), y AS (SELECT run_id, g - u AS ordinal, t AS t_response FROM e WHERE side = 1 AND u <= pu)
SELECT run_id, ordinal, t_call, t_response, coalesce((t_response - t_call) / {float(H)}, 'infinity'::DOUBLE) AS delay FROM x LEFT JOIN y USING (run_id, ordinal)""")
def ordinal_pairing(spark, sf):
    rows = messages(spark, sf)
    out = matching.ordinal_pairs(_topic(rows, "click"), _topic(rows, "purchase"), RUN, T, tie=SEQ)
    return out.withColumn("delay", F.col("delay") / F.lit(float(H)))


@query("alternating_pairs", "run_id:i ordinal:i t_call:i t_answer:i miss:f", f"""
WITH {EV}, b AS (SELECT *, CASE topic WHEN 'click' THEN 0 ELSE 1 END AS side FROM ev WHERE topic IN ('click', 'purchase')),
c AS (SELECT *, lag(side) OVER {W} AS was FROM b), d AS (SELECT * FROM c WHERE was IS DISTINCT FROM side),
e AS (SELECT *, lead(t) OVER {W} AS t_answer, lead(value) OVER {W} AS v2 FROM d)
SELECT run_id, row_number() OVER {W} AS ordinal, t AS t_call, t_answer, abs(value - v2) AS miss FROM e WHERE side = 0""")
def alternating_pairs(spark, sf):
    out = matching.alternating_pairs(messages(spark, sf), RUN, T, SEQ, F.col("topic") == "click", F.col("topic") == "purchase", ["value"])
    return out.withColumn("miss", F.abs(F.col("value_call") - F.col("value_answer")))


@query("request_chain", "run_id:i t_signup:i t_click:i t_purchase:i duration:i", f"""
WITH {EV}, a AS (SELECT run_id, min(t) FILTER (topic = 'signup') AS t_signup FROM ev GROUP BY run_id),
b AS (SELECT run_id, min(t) AS t_click FROM ev JOIN a USING (run_id) WHERE topic = 'click' AND t > t_signup GROUP BY run_id),
c AS (SELECT run_id, min(t) AS t_purchase FROM ev JOIN b USING (run_id) WHERE topic = 'purchase' AND t > t_click GROUP BY run_id)
SELECT run_id, t_signup, t_click, t_purchase, t_purchase - t_signup AS duration FROM a LEFT JOIN b USING (run_id) LEFT JOIN c USING (run_id)""")
def request_chain(spark, sf):
    steps = [(name, F.col("topic") == name, "first") for name in ("signup", "click", "purchase")]
    out = matching.request_chain(messages(spark, sf), RUN, T, steps, SEQ)
    return out.withColumn("duration", F.col("t_purchase") - F.col("t_signup"))


@query("request_chain_last_seen", "run_id:i t_request:i t_ack:i t_last:i", f"""
WITH {EV}, a AS (SELECT run_id, max(t) FILTER (topic = 'signup') AS t_request FROM ev GROUP BY run_id),
b AS (SELECT run_id, min(t) AS t_ack FROM ev JOIN a USING (run_id) WHERE topic = 'click' AND t > t_request GROUP BY run_id),
c AS (SELECT run_id, max(t) AS t_last FROM ev JOIN b USING (run_id) WHERE topic = 'view' AND t > t_ack GROUP BY run_id)
SELECT run_id, t_request, t_ack, t_last FROM a LEFT JOIN b USING (run_id) LEFT JOIN c USING (run_id)""")
def request_chain_last_seen(spark, sf):
    steps = [("request", F.col("topic") == "signup", "last"), ("ack", F.col("topic") == "click", "first"),
             ("last", F.col("topic") == "view", "last")]
    return matching.request_chain(messages(spark, sf), RUN, T, steps, SEQ)


@query("fifo_match", "k:i t:i seq:i t_source:i delay:i", f"""
WITH {EV}, b AS (SELECT k, t, seq, CASE topic WHEN 'click' THEN 0 ELSE 1 END AS side FROM ev WHERE topic IN ('click', 'purchase')), {_QUEUE.format(key="k")},
x AS (SELECT k, s AS r, t AS t_source FROM e WHERE side = 0), y AS (SELECT k, CASE WHEN u <= pu THEN g - u END AS r, t, seq FROM e WHERE side = 1)
SELECT k, t, seq, t_source, t - t_source AS delay FROM y LEFT JOIN x USING (k, r)""")
def fifo_match(spark, sf):
    rows = messages(spark, sf)
    return matching.fifo_match(_topic(rows, "click"), _topic(rows, "purchase"), "k", T, source_tie=SEQ, target_tie=SEQ, keep_target=("seq",))


@query("fifo_match_bounded", "k:i t:i seq:i t_source:i delay:i", f"""
WITH RECURSIVE {EV}, s AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t, seq) AS r FROM ev WHERE topic = 'click'),
g AS (SELECT k, t, seq, row_number() OVER (PARTITION BY k ORDER BY t, seq) AS n FROM ev WHERE topic = 'purchase'),
h AS (SELECT g.*, count(s.r) FILTER (s.t <= g.t - {2*DAY}) AS lo, count(s.r) FILTER (s.t <= g.t) AS hi FROM g LEFT JOIN s ON s.k = g.k GROUP BY ALL),
p AS (SELECT k, n, t, seq, lo + 1 AS pick, hi, least(lo + 1, hi) AS used FROM h WHERE n = 1
 UNION ALL SELECT h.k, h.n, h.t, h.seq, greatest(p.used, h.lo) + 1, h.hi, least(greatest(p.used, h.lo) + 1, h.hi) FROM p JOIN h ON h.k = p.k AND h.n = p.n + 1)
SELECT p.k, p.t, p.seq, s.t AS t_source, p.t - s.t AS delay FROM p LEFT JOIN s ON s.k = p.k AND s.r = p.pick AND p.pick <= p.hi""")
def fifo_match_bounded(spark, sf):
    rows = messages(spark, sf)
    return matching.fifo_match_bounded(_topic(rows, "click"), _topic(rows, "purchase"), "k", T, 2 * DAY, source_tie=SEQ, target_tie=SEQ, keep_target=("seq",))


@query("lookup_first", "run_id:i k:i t:i seq:i t_answer:i known:b", f"""
WITH {EV}, a AS (SELECT run_id, k, min(t) AS t_answer FROM ev WHERE topic = 'purchase' GROUP BY ALL)
SELECT run_id, k, t, seq, t_answer, t_answer IS NOT NULL AS known FROM ev LEFT JOIN a USING (run_id, k) WHERE topic = 'view'""")
def lookup_first(spark, sf):
    rows = messages(spark, sf)
    return matching.lookup_first(_topic(rows, "view"), _topic(rows, "purchase"), ["run_id", "k"], T, tie=SEQ, columns=[])


@query("unknown_keys", "run_id:i k:i seq:i", f"""
WITH {EV} SELECT run_id, k, seq FROM ev e WHERE topic = 'view' AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.topic = 'purchase' AND x.run_id = e.run_id AND x.k = e.k)""")
def unknown_keys(spark, sf):
    rows = messages(spark, sf)
    return _topic(rows, "view").join(_topic(rows, "purchase").select("run_id", "k").distinct(), ["run_id", "k"], "left_anti")


@query("hop_latency", "run_id:i t_vehicle:i t_roadside:i t_cloud:i vehicle_to_roadside:i roadside_to_cloud:i", f"""
WITH {EV}, a AS (SELECT run_id, min(t) FILTER (topic = 'signup') AS t_vehicle, min(t) FILTER (topic = 'click') AS t_roadside, min(t) FILTER (topic = 'purchase') AS t_cloud FROM ev GROUP BY run_id)
SELECT *, t_roadside - t_vehicle AS vehicle_to_roadside, t_cloud - t_roadside AS roadside_to_cloud FROM a WHERE t_vehicle IS NOT NULL""")
def hop_latency(spark, sf):
    rows = messages(spark, sf)
    hops = [("vehicle", _topic(rows, "signup")), ("roadside", _topic(rows, "click")), ("cloud", _topic(rows, "purchase"))]
    return matching.hop_latency(hops, RUN, T)


@query("equi_join_guarded", "l_orderkey:i l_linenumber:i o_custkey:i n:i", """
SELECT l_orderkey, l_linenumber, o_custkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL""")
def equi_join_guarded(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    reports = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = matching.guarded_join(lines, reports, ["l_orderkey"], ["o_custkey"])
    return joined.groupBy("l_orderkey", "l_linenumber", "o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("repeated_keys", "l_orderkey:i l_linenumber:i n:i", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def repeated_keys(spark, sf):
    return matching.repeated_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("containment", "run_id:i n_members:i n_missing:i all_in:b none_in:b", f"""
WITH {EV}, a AS (SELECT DISTINCT run_id, k FROM ev WHERE topic = 'purchase'), b AS (SELECT DISTINCT run_id, k FROM ev WHERE topic = 'view')
SELECT a.run_id, count(*) AS n_members, count(*) FILTER (b.k IS NULL) AS n_missing, n_missing = 0 AS all_in, n_missing = n_members AS none_in
FROM a LEFT JOIN b ON a.run_id = b.run_id AND a.k = b.k GROUP BY a.run_id""".replace("n_missing = 0 AS all_in, n_missing = n_members AS none_in", "count(*) FILTER (b.k IS NULL) = 0 AS all_in, count(*) FILTER (b.k IS NULL) = count(*) AS none_in"))
def containment(spark, sf):
    rows = messages(spark, sf)
    members = _topic(rows, "purchase").select("run_id", "k").distinct()
    whole = _topic(rows, "view").select("run_id", "k").distinct().withColumn("found", F.lit(True))
    out = members.join(whole, ["run_id", "k"], "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if(F.col("found").isNull()).alias("n_missing"))
    return out.withColumn("all_in", F.col("n_missing") == 0).withColumn("none_in", F.col("n_missing") == F.col("n_members"))


@query("route_containment", "doc_id:i n_members:i all_in:b none_in:b", """
WITH a AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents)
SELECT doc_id, len(w) AS n_members, list_has_all(w, ['the', 'and']) AS all_in, NOT list_has_any(w, ['the', 'and']) AS none_in FROM a""")
def route_containment(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", F.array_distinct(F.split("text", " ")).alias("whole"), F.array(F.lit("the"), F.lit("and")).alias("wanted"))
    return rows.select("doc_id", F.size("whole").alias("n_members"), matching.contains_all(rows, "whole", "wanted").alias("all_in"),
                       (~F.arrays_overlap("whole", "wanted")).alias("none_in"))


@query("lane_membership", "run_id:i seq:i lane:s", f"""
WITH {EV} SELECT run_id, seq, CASE WHEN k // 10 IN (SELECT s_nationkey % 10 FROM supplier WHERE s_acctbal > 8000) THEN 'right' WHEN k // 10 IN (1, 3, 5) THEN 'middle' ELSE 'other' END AS lane FROM ev""")
def lane_membership(spark, sf):
    right = load(spark, sf, "supplier").where("s_acctbal > 8000").select((F.col("s_nationkey").cast("long") % 10).alias("lanelet")).distinct()
    rows = messages(spark, sf).withColumn("lanelet", F.floor(F.col("k") / 10))
    marked = rows.join(right.withColumn("is_right", F.lit(True)), "lanelet", "left")
    lane = F.when(F.col("is_right"), "right").when(F.col("lanelet").isin(1, 3, 5), "middle").otherwise("other")
    return marked.withColumn("lane", lane)


@query("simulation_frequency", "run_id:i seq:i sim_time:i frequency:f frequency_mean:f", f"""
WITH {EV}, c AS (SELECT run_id, t, k * 1000 + seq AS sim FROM ev WHERE topic = 'view'), m AS (SELECT run_id, t, seq FROM ev WHERE topic = 'click'),
j AS (SELECT m.run_id, m.t, m.seq, c.sim AS sim_time FROM m ASOF JOIN c ON m.run_id = c.run_id AND m.t >= c.t),
f AS (SELECT *, 1000.0 / nullif(sim_time - lag(sim_time) OVER {W}, 0) AS frequency FROM j)
SELECT run_id, seq, sim_time, frequency, CASE WHEN count(frequency) OVER w = 3 THEN avg(frequency) OVER w END AS frequency_mean FROM f
WINDOW w AS (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def simulation_frequency(spark, sf):
    from ...operators.ordered import Ordered

    rows = messages(spark, sf)
    clock = _topic(rows, "view").select("run_id", "t", (F.col("k") * 1000 + F.col("seq")).alias("sim_time"))
    timed = asof.clock_at(_topic(rows, "click").select("run_id", "t", "seq"), clock, RUN, T, "sim_time")
    o = Ordered.of(timed.where(F.col("sim_time").isNotNull()), RUN, T, SEQ).prev(before="sim_time")
    o = o.with_columns(frequency=F.try_divide(F.lit(1000.0), F.col("sim_time") - F.col("before")))
    full = lambda w: F.when(F.count("frequency").over(w) == 3, F.avg("frequency").over(w))
    return o.rows(2, 0, frequency_mean=full).df


@query("shared_position_error", "run_id:i n:i mean:f worst:f passed:b", f"""
WITH {EV}, d AS (SELECT run_id, k, min(t) AS t, min(value) AS x FROM ev WHERE topic = 'click' GROUP BY ALL), r AS (SELECT run_id, k, min(value) AS x FROM ev WHERE topic = 'view' GROUP BY ALL)
SELECT d.run_id, count(*) AS n, avg(abs(d.x - r.x)) AS mean, max(abs(d.x - r.x)) AS worst, max(abs(d.x - r.x)) <= 60 AS passed FROM d JOIN r ON d.run_id = r.run_id AND d.k = r.k GROUP BY d.run_id""")
def shared_position_error(spark, sf):
    rows = messages(spark, sf)
    one = lambda topic, name: _topic(rows, topic).groupBy("run_id", "k").agg(F.min("value").alias(name))
    joined = matching.guarded_join(one("click", "x"), one("view", "rx"), ["run_id", "k"], ["rx"])
    error = F.abs(F.col("x") - F.col("rx"))
    return joined.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean"), F.max(error).alias("worst")).withColumn(
        "passed", F.col("worst") <= 60)


@query("dim_lookup", "c_custkey:i n_name:s r_name:s n_matches:i", """
SELECT c_custkey, n_name, r_name, 1 AS n_matches FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def dim_lookup(spark, sf):
    nations = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return quality.dimension(load(spark, sf, "customer"), nations, "c_nationkey", "n_nationkey", ["n_name", "r_name"])


@query("interval_join", "run_id:i interval_no:i n_inside:i mean_inside:f", f"""
WITH {EV}, a AS (SELECT *, k < 70 AS on_, lag(k < 70) OVER {W} AS was, lead(t) OVER {W} AS nt FROM ev),
b AS (SELECT *, sum(CASE WHEN on_ AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS no FROM a),
i AS (SELECT run_id, no, min(t) AS t0, max(coalesce(nt, t)) AS t1 FROM b WHERE on_ GROUP BY run_id, no)
SELECT i.run_id, i.no AS interval_no, count(*) AS n_inside, avg(value) AS mean_inside FROM i JOIN ev ON ev.run_id = i.run_id AND ev.t >= i.t0 AND ev.t < i.t1 + 0 GROUP BY ALL""")
def interval_join(spark, sf):
    rows = messages(spark, sf)
    engaged = intervals.state_intervals(rows, RUN, T, SEQ, F.col("k") < 70).withColumnRenamed("seq", "interval_no")
    inside = intervals.in_intervals(rows, engaged, RUN, T, SEQ, carry=("interval_no",))
    inside = inside.where(F.col("interval_no").isNotNull() & (F.col("t") < F.col("end")))
    return inside.groupBy("run_id", "interval_no").agg(F.count(F.lit(1)).alias("n_inside"), F.avg("value").alias("mean_inside"))


@query("outside_intervals", "run_id:i n_outside:i n_margin:i", f"""
WITH {EV}, i AS (SELECT run_id, min(t) AS t0, max(t) AS t1 FROM ev WHERE topic = 'purchase' GROUP BY run_id)
SELECT ev.run_id, count(*) FILTER (t0 IS NULL OR t < t0 OR t > t1) AS n_outside, count(*) FILTER (t >= t0 + {5*H} AND t <= t1 - {H}) AS n_margin FROM ev LEFT JOIN i USING (run_id) GROUP BY ev.run_id""")
def outside_intervals(spark, sf):
    rows = messages(spark, sf)
    whole = _topic(rows, "purchase").groupBy("run_id").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    hit = intervals.in_intervals(rows, whole, RUN, T, SEQ).withColumnsRenamed({"start": "a", "end": "b"})
    hit = intervals.in_intervals(hit, whole, RUN, T, SEQ, lead_in=5 * H, lead_out=H)
    return hit.groupBy("run_id").agg(F.count_if(F.col("a").isNull()).alias("n_outside"), F.count("start").alias("n_margin"))


@query("before_after_ack", "run_id:i k:i n_before:i n_after:i t_ack:i", f"""
WITH {EV}, a AS (SELECT run_id, k, min(t) AS t_ack FROM ev WHERE topic = 'purchase' GROUP BY ALL)
SELECT run_id, k, count(*) FILTER (t_ack IS NULL OR t < t_ack) AS n_before, count(*) FILTER (t >= t_ack) AS n_after, max(t_ack) AS t_ack
FROM ev LEFT JOIN a USING (run_id, k) WHERE topic <> 'purchase' GROUP BY run_id, k""")
def before_after_ack(spark, sf):
    rows = messages(spark, sf)
    return matching.counts_around(rows.where(F.col("topic") != "purchase"), _topic(rows, "purchase"), ["run_id", "k"], T)


@query("part_completeness", "run_id:i n_parts:i complete:b", f"""
WITH {EV} SELECT run_id, count(DISTINCT topic) AS n_parts, count(DISTINCT topic) = 5 AS complete FROM ev GROUP BY run_id""")
def part_completeness(spark, sf):
    return matching.complete_parts(messages(spark, sf), RUN, "topic", 5)


@query("drop_repeats", "k:i t:i channel:s t_first:i", f"""
WITH {EV}, b AS (SELECT *, lag(t) OVER w AS pt, lag(topic) OVER w AS pc, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY k ORDER BY t, seq)),
c AS (SELECT *, pc IS DISTINCT FROM topic AS head FROM b), h AS (SELECT k, rn, t, topic, lead(rn) OVER (PARTITION BY k ORDER BY rn) AS nrn, lead(t) OVER (PARTITION BY k ORDER BY rn) AS nt FROM c WHERE head),
e AS (SELECT *, sum(CASE WHEN nt - t <= {12*H} THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chain FROM h),
z AS (SELECT k, rn, t, last_value(t) OVER x AS zt, last_value(topic) OVER x AS zc FROM e WINDOW x AS (PARTITION BY k, coalesce(chain, 0) ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
n AS (SELECT c.k, c.rn, c.t, c.topic, c.head, min(z.rn) AS nrn FROM c LEFT JOIN z ON z.k = c.k AND z.rn > c.rn WHERE NOT (c.head AND c.pt IS NOT NULL AND c.t - c.pt <= {12*H}) GROUP BY ALL)
SELECT n.k, CASE WHEN n.head THEN o.zt WHEN z.t - n.t <= {12*H} THEN z.zt ELSE n.t END AS t,
 CASE WHEN n.head THEN o.zc WHEN z.t - n.t <= {12*H} THEN z.zc ELSE n.topic END AS channel, n.t AS t_first
FROM n LEFT JOIN z ON z.k = n.k AND z.rn = n.nrn LEFT JOIN z o ON o.k = n.k AND o.rn = n.rn""")
def drop_repeats(spark, sf):
    rows = messages(spark, sf).withColumnRenamed("topic", "channel")
    return matching.drop_repeats(rows, "k", T, "channel", 12 * H, SEQ)


@query("step_sync", "run_id:i step:i first_next:i last_here:i lag:i synced:b", f"""
WITH {EV}, s AS (SELECT run_id, t // {3*DAY} AS step, topic, min(t) AS t FROM ev GROUP BY ALL),
g AS (SELECT run_id, step, count(*) AS n, min(t) AS lo, max(t) AS hi FROM s GROUP BY ALL)
SELECT a.run_id, a.step, b.lo AS first_next, a.hi AS last_here, b.lo - a.hi AS lag, b.lo > a.hi - {DAY} AS synced
FROM g a JOIN g b ON a.run_id = b.run_id AND b.step = a.step + 1 WHERE a.n = 5 AND b.n = 5""")
def step_sync(spark, sf):
    from ...streaming import sync

    steps = messages(spark, sf).select("run_id", F.floor(F.col("t") / F.lit(3 * DAY)).alias("sim_time"), F.col("topic").alias("source"), F.col("t").alias("system_time"))
    out = sync.sync_check(steps, RUN, 5, step=1, tolerance=DAY)
    return out.withColumnsRenamed({"sim_time": "step", "first_next": "first_next"})


@query("step_delays", "run_id:i step:i source:s delay:i", f"""
WITH {EV}, s AS (SELECT run_id, t // {3*DAY} AS step, topic AS source, min(t) AS t FROM ev GROUP BY ALL),
g AS (SELECT run_id, step, count(*) AS n, min(t) AS lo FROM s GROUP BY ALL),
p AS (SELECT a.run_id, a.step, a.lo, b.lo AS nlo FROM g a JOIN g b ON a.run_id = b.run_id AND b.step = a.step + 1 WHERE a.n = 5 AND b.n = 5)
SELECT run_id, step, source, CASE WHEN source = 'view' THEN nlo - t ELSE t - lo END AS delay FROM p JOIN s USING (run_id, step)""")
def step_delays(spark, sf):
    from ...streaming import sync

    steps = messages(spark, sf).select("run_id", F.floor(F.col("t") / F.lit(3 * DAY)).alias("sim_time"), F.col("topic").alias("source"), F.col("t").alias("system_time"))
    return sync.source_delays(steps, RUN, 5, step=1, master="view").withColumnRenamed("sim_time", "step")


@query("missing_steps", "step:i n_runs:i", f"""
WITH {EV}, a AS (SELECT DISTINCT run_id, t // {DAY} AS d FROM ev), b AS (SELECT *, lead(d) OVER w AS n1, lead(d, 2) OVER w AS n2 FROM a WINDOW w AS (PARTITION BY run_id ORDER BY d))
SELECT d + 1 AS step, count(*) AS n_runs FROM b WHERE n1 - d > 1 AND n2 IS NOT NULL GROUP BY ALL""")
def missing_steps(spark, sf):
    from ...streaming import sync

    steps = messages(spark, sf).select("run_id", F.floor(F.col("t") / F.lit(DAY)).alias("sim_time"))
    return sync.missing_steps(steps, RUN, 1, 0).groupBy(F.col("sim_time").alias("step")).agg(F.count(F.lit(1)).alias("n_runs"))


@query("run_lists", "run_id:i role:s", f"""
WITH {EV} (SELECT DISTINCT run_id, 'buyer' AS role FROM ev WHERE topic = 'purchase' AND value > 150) UNION ALL
(SELECT DISTINCT run_id, 'both' FROM ev WHERE topic = 'view' AND value > 150 INTERSECT SELECT DISTINCT run_id, 'both' FROM ev WHERE topic = 'click' AND value > 150) UNION ALL
(SELECT DISTINCT run_id, 'rest' FROM ev EXCEPT SELECT DISTINCT run_id, 'rest' FROM ev WHERE topic = 'purchase' AND value > 150)""")
def run_lists(spark, sf):
    rows = messages(spark, sf)
    high = lambda topic: rows.where((F.col("topic") == topic) & (F.col("value") > 150)).select("run_id").distinct()
    named = lambda df, role: df.withColumn("role", F.lit(role))
    everyone = rows.select("run_id").distinct()
    return named(high("purchase"), "buyer").unionByName(named(high("view").intersect(high("click")), "both")).unionByName(
        named(everyone.join(high("purchase"), "run_id", "left_anti"), "rest"))


@query("match_shortfall", "n_targets:i n_matched:i complete:b", f"""
WITH {EV}, b AS (SELECT k, t, seq, CASE topic WHEN 'click' THEN 0 ELSE 1 END AS side FROM ev WHERE topic IN ('click', 'purchase')), {_QUEUE.format(key="k")}
SELECT count(*) FILTER (side = 1) AS n_targets, count(*) FILTER (side = 1 AND u <= pu) AS n_matched, count(*) FILTER (side = 1 AND u > pu) = 0 AS complete FROM e""")
def match_shortfall(spark, sf):
    rows = messages(spark, sf)
    pairs = matching.fifo_match(_topic(rows, "click"), _topic(rows, "purchase"), "k", T, source_tie=SEQ, target_tie=SEQ)
    return quality.match_counts(pairs, "t_source")


@query("prerequisites", "run_id:i verdict:s", f"""
WITH {EV}, a AS (SELECT run_id, min(t) FILTER (topic = 'signup' AND value > 100) AS t0, max(value) FILTER (topic = 'purchase') AS v FROM ev GROUP BY run_id)
SELECT run_id, CASE WHEN t0 IS NULL OR v IS NULL THEN 'not_evaluated' WHEN v >= 100 THEN 'passed' ELSE 'failed' END AS verdict FROM a""")
def prerequisites(spark, sf):
    rows = messages(spark, sf)
    facts = rows.groupBy("run_id").agg(
        F.min(F.when((F.col("topic") == "signup") & (F.col("value") > 100), F.col("t"))).alias("t0"),
        F.max(F.when(F.col("topic") == "purchase", F.col("value"))).alias("v"))
    return facts.select("run_id", quality.verdict([F.col("t0"), F.col("v")], F.col("v") >= 100).alias("verdict"))


@query("newest_row", "topic:s run_id:i seq:i", f"""
WITH {EV} SELECT topic, run_id, seq FROM ev QUALIFY row_number() OVER (PARTITION BY topic, run_id ORDER BY t DESC, seq DESC) = 1""")
def newest_row(spark, sf):
    return reshape.latest(messages(spark, sf), ["topic", "run_id"], [F.col("t"), F.col("seq")])


@query("first_hits", "run_id:i seq:i rank:i", f"""
WITH {EV} SELECT run_id, seq, row_number() OVER {W} AS rank FROM ev WHERE value > 60 QUALIFY row_number() OVER {W} <= 3""")
def first_hits(spark, sf):
    return stats.top_per_group(messages(spark, sf).where("value > 60"), RUN, [F.col("t"), F.col("seq")], 3)


_REPEATS = ORACLES["drop_repeats"]


@query("cloud_delays", "k:i t:i t_source:i delay:i", f"""
WITH RECURSIVE {EV}, s AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t, seq) AS r FROM ev WHERE topic = 'click'),
d AS (SELECT k, t, channel, row_number() OVER (PARTITION BY k ORDER BY t, t_first) AS n FROM ({_REPEATS}) WHERE channel = 'purchase'),
h AS (SELECT d.k, d.n, d.t, count(s.r) FILTER (s.t <= d.t - {2*DAY}) AS lo, count(s.r) FILTER (s.t <= d.t) AS hi FROM d LEFT JOIN s ON s.k = d.k GROUP BY ALL),
p AS (SELECT k, n, t, lo + 1 AS pick, hi, least(lo + 1, hi) AS used FROM h WHERE n = 1
 UNION ALL SELECT h.k, h.n, h.t, greatest(p.used, h.lo) + 1, h.hi, least(greatest(p.used, h.lo) + 1, h.hi) FROM p JOIN h ON h.k = p.k AND h.n = p.n + 1)
SELECT p.k, p.t, s.t AS t_source, p.t - s.t AS delay FROM p LEFT JOIN s ON s.k = p.k AND s.r = p.pick AND p.pick <= p.hi""")
def cloud_delays(spark, sf):
    rows = messages(spark, sf)
    once = matching.drop_repeats(rows.withColumnRenamed("topic", "channel"), "k", T, "channel", 12 * H, SEQ)
    sent = once.where(F.col("channel") == "purchase").select("k", "t", "t_first")
    return matching.fifo_match_bounded(_topic(rows, "click"), sent, "k", T, 2 * DAY, source_tie=SEQ, target_tie="t_first")
