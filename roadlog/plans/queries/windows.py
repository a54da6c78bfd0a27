"""Queries of the window and sequence family over the events table as a message log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import anchored, hysteresis, intervals, rates, rolling
from ...operators.ordered import Ordered
from ..registry import DAY, EV, H, messages, query

RUN, T, SEQ = ["run_id"], "t", ["seq"]
W = "(PARTITION BY run_id ORDER BY t, seq)"


@query("gap_coverage", "run_id:i covered:i total:i pct:f max_gap:i n_long:i passed:b", f"""
WITH {EV}, g AS (SELECT run_id, t - lag(t) OVER {W} AS gap FROM ev)
SELECT run_id, coalesce(sum(gap) FILTER (gap < {12*H}), 0) AS covered, sum(gap) AS total,
 covered * 100.0 / nullif(total, 0) AS pct, max(gap) AS max_gap, count(*) FILTER (gap >= {12*H}) AS n_long,
 covered * 100.0 / nullif(total, 0) >= 40 AS passed FROM g GROUP BY run_id""")
def gap_coverage(spark, sf):
    out = rates.gap_coverage(messages(spark, sf), RUN, T, SEQ, 12 * H)
    return out.withColumn("passed", F.col("pct") >= 40)


@query("max_gap_rule", "run_id:i topic:s max_gap:i n_gaps:i passed:b", f"""
WITH {EV}, g AS (SELECT run_id, topic, t - lag(t) OVER (PARTITION BY run_id, topic ORDER BY t, seq) AS gap FROM ev)
SELECT run_id, topic, max(gap) AS max_gap, count(gap) AS n_gaps, max(gap) < {5*DAY} AS passed FROM g GROUP BY ALL""")
def max_gap_rule(spark, sf):
    out = rates.gap_coverage(messages(spark, sf), ["run_id", "topic"], T, SEQ, 5 * DAY)
    return out.withColumn("passed", F.col("max_gap") < 5 * DAY)


@query("time_in_state", "run_id:i t_true:i t_false:i pct:f", f"""
WITH {EV}, g AS (SELECT run_id, value, t - lag(t) OVER {W} AS gap FROM ev)
SELECT run_id, coalesce(sum(gap) FILTER (value > 40), 0) AS t_true, coalesce(sum(gap) FILTER (NOT value > 40), 0) AS t_false,
 t_true * 100.0 / nullif(sum(gap), 0) AS pct FROM g GROUP BY run_id""")
def time_in_state(spark, sf):
    return rates.time_in_state(messages(spark, sf), RUN, T, SEQ, F.col("value") > 40)


@query("average_frequency", "run_id:i topic:s n:i frequency:f frequency_sd:f", f"""
WITH {EV}, g AS (SELECT run_id, topic, t, (t - lag(t) OVER (PARTITION BY run_id, topic ORDER BY t)) / {float(DAY)} AS gap FROM ev)
SELECT run_id, topic, count(*) AS n, (count(*) - 1.0) / nullif((max(t) - min(t)) / {float(DAY)}, 0) AS frequency,
 stddev_pop(1.0 / nullif(gap, 0)) AS frequency_sd FROM g GROUP BY ALL""")
def average_frequency(spark, sf):
    return rates.average_frequency(messages(spark, sf), ["run_id", "topic"], T, DAY)


_ENGAGED = f"""
WITH {EV}, a AS (SELECT *, value >= 30 AS engaged, lag(value >= 30) OVER {W} AS was, lead(t) OVER {W} AS t_next FROM ev),
b AS (SELECT *, sum(CASE WHEN engaged AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS interval_no FROM a)
"""


@query("state_intervals", "run_id:i interval_no:i t_start:i t_end:i n:i", f"""{_ENGAGED}
SELECT run_id, interval_no, min(t) AS t_start, coalesce(arg_max(coalesce(t_next, -1), seq), 0) AS x,
 CASE WHEN x = -1 THEN max(t) ELSE x END AS t_end, count(*) AS n FROM b WHERE engaged GROUP BY run_id, interval_no""")
def state_intervals(spark, sf):
    out = intervals.state_intervals(messages(spark, sf), RUN, T, SEQ, F.col("value") >= 30)
    return out.withColumnsRenamed({"seq": "interval_no", "start": "t_start", "end": "t_end"})


@query("state_intervals_last_true", "run_id:i interval_no:i t_start:i t_end:i n:i", f"""{_ENGAGED}
SELECT run_id, interval_no, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM b WHERE engaged GROUP BY run_id, interval_no""")
def state_intervals_last_true(spark, sf):
    out = intervals.state_intervals(messages(spark, sf), RUN, T, SEQ, F.col("value") >= 30, close="last_true")
    return out.withColumnsRenamed({"seq": "interval_no", "start": "t_start", "end": "t_end"})


_BAND = f"""
WITH {EV}, a AS (SELECT *, value BETWEEN 20 AND 80 AS ok FROM ev),
b AS (SELECT *, lag(ok) OVER {W} AS was FROM a),
c AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS isl FROM b),
d AS (SELECT run_id, isl, min(t) AS a, max(t) AS z, count(*) AS n FROM c WHERE ok GROUP BY run_id, isl)
"""


@query("longest_band_run", "run_id:i longest:i t_start:i n_runs:i passed:b", f"""{_BAND}
SELECT run_id, max(z - a) AS longest, arg_min(a, (a - z) * 100 + isl) AS t_start, count(*) AS n_runs, max(z - a) >= {DAY} AS passed
FROM d GROUP BY run_id""")
def longest_band_run(spark, sf):
    out = intervals.longest_run(messages(spark, sf), RUN, T, SEQ, F.col("value").between(20, 80))
    return out.withColumn("passed", F.col("longest") >= DAY).withColumnRenamed("start", "t_start")


@query("band_runs", "run_id:i run_no:i t_start:i t_end:i n:i", f"""{_BAND}
SELECT run_id, isl AS run_no, a AS t_start, z AS t_end, n FROM d WHERE n >= 3 AND z - a >= {6*H}""")
def band_runs(spark, sf):
    out = intervals.runs(messages(spark, sf), RUN, T, SEQ, F.col("value").between(20, 80), min_rows=3, min_duration=6 * H)
    return out.withColumnsRenamed({"seq": "run_no", "start": "t_start", "end": "t_end"})


def _consecutive_sql(op: str) -> str:
    return f"""
WITH {EV}, a AS (SELECT *, value {op} lag(value) OVER {W} AS mv, lag(t) OVER {W} AS pt FROM ev),
b AS (SELECT *, coalesce(mv, false) AS m, lag(coalesce(mv, false)) OVER {W} AS pm FROM a),
c AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(pm, false) THEN 1 ELSE 0 END) OVER {W} AS isl FROM b),
d AS (SELECT run_id, isl, min(pt) AS t_base, min(t) AS t_start, max(t) AS t_end, count(*) AS n FROM c WHERE m GROUP BY run_id, isl HAVING count(*) >= 3)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t_start) = 1"""


@query("consecutive_increase", "run_id:i t_base:i t_start:i t_end:i n:i", _consecutive_sql(">"))
def consecutive_increase(spark, sf):
    out = intervals.consecutive(messages(spark, sf), RUN, T, SEQ, "value", 1, 3)
    return out.withColumnsRenamed({"base": "t_base", "start": "t_start", "end": "t_end"})


@query("consecutive_decrease", "run_id:i t_base:i t_start:i t_end:i n:i", _consecutive_sql("<"))
def consecutive_decrease(spark, sf):
    out = intervals.consecutive(messages(spark, sf), RUN, T, SEQ, "value", -1, 3)
    return out.withColumnsRenamed({"base": "t_base", "start": "t_start", "end": "t_end"})


@query("resetting_sum", "run_id:i seq:i gap:i duration:i", f"""
WITH {EV}, a AS (SELECT *, t - lag(t) OVER {W} AS gap FROM ev),
b AS (SELECT *, sum(CASE WHEN coalesce(gap <= {12*H}, false) THEN 0 ELSE 1 END) OVER {W} AS isl FROM a)
SELECT run_id, seq, gap, sum(CASE WHEN coalesce(gap <= {12*H}, false) THEN gap ELSE 0 END) OVER (PARTITION BY run_id, isl ORDER BY t, seq) AS duration FROM b""")
def resetting_sum(spark, sf):
    return rolling.resetting_sum(messages(spark, sf), RUN, T, SEQ, 12 * H)


@query("subtracks", "run_id:i track:i t_start:i n:i", f"""
WITH {EV}, a AS (SELECT *, t - lag(t) OVER {W} AS gap, abs(value - lag(value) OVER {W}) AS jump FROM ev),
b AS (SELECT *, sum(CASE WHEN gap > {DAY} OR jump > 100 THEN 1 ELSE 0 END) OVER {W} AS track FROM a)
SELECT run_id, track, min(t) AS t_start, count(*) AS n FROM b GROUP BY run_id, track""")
def subtracks(spark, sf):
    out = rolling.subtracks(messages(spark, sf), RUN, T, SEQ, lambda p, c: F.abs(c("value") - p("value")), DAY, 100)
    return out.groupBy("run_id", "track").agg(F.min("t").alias("t_start"), F.count(F.lit(1)).alias("n"))


@query("id_swaps", "n_entities:i mean_swaps:f sd_swaps:f pct_without:f", f"""
WITH {EV}, a AS (SELECT *, t - lag(t) OVER (PARTITION BY run_id, topic ORDER BY t, seq) AS gap FROM ev),
b AS (SELECT run_id, topic, count(*) FILTER (gap > {5*DAY}) AS swaps FROM a GROUP BY run_id, topic)
SELECT count(*) AS n_entities, avg(swaps) AS mean_swaps, stddev_pop(swaps) AS sd_swaps, count(*) FILTER (swaps < 1) * 100.0 / count(*) AS pct_without FROM b""")
def id_swaps(spark, sf):
    tracks = rolling.subtracks(messages(spark, sf), ["run_id", "topic"], T, SEQ, lambda p, c: F.lit(0.0), 5 * DAY, 1)
    swaps = tracks.groupBy("run_id", "topic").agg(F.max("track").alias("swaps"))
    return swaps.agg(F.count(F.lit(1)).alias("n_entities"), F.avg("swaps").alias("mean_swaps"),
                     F.stddev_pop("swaps").alias("sd_swaps"),
                     (F.count_if(F.col("swaps") < 1) * 100.0 / F.count(F.lit(1))).alias("pct_without"))


@query("episode_min", "run_id:i episode:i t_start:i t_end:i lowest:f t_lowest:i", f"""
WITH {EV}, a AS (SELECT *, k < 60 AS slow, lag(k < 60) OVER {W} AS was FROM ev),
b AS (SELECT *, sum(CASE WHEN slow AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS episode FROM a)
SELECT run_id, episode, min(t) AS t_start, max(t) AS t_end, min(value) AS lowest, first(t ORDER BY value, t, seq) AS t_lowest
FROM b WHERE slow GROUP BY run_id, episode""")
def episode_min(spark, sf):
    out = intervals.runs(messages(spark, sf), RUN, T, SEQ, F.col("k") < 60, lowest=F.min("value"),
                         t_lowest=F.min_by("t", F.struct("value", "t", "seq")))
    return out.withColumnsRenamed({"seq": "episode", "start": "t_start", "end": "t_end"})


@query("rolling_mean_full", "run_id:i seq:i mean:f", f"""
WITH {EV} SELECT run_id, seq, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS mean FROM ev
WINDOW w AS (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_mean_full(spark, sf):
    return rolling.rolling_mean(messages(spark, sf), RUN, T, SEQ, "value", 5)


@query("moving_average_centered", "run_id:i seq:i mean:f", f"""
WITH {EV} SELECT run_id, seq, CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END AS mean FROM ev
WINDOW w AS (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def moving_average_centered(spark, sf):
    return rolling.rolling_mean(messages(spark, sf), RUN, T, SEQ, "value", 5, centered=True)


@query("trailing_mean", "run_id:i seq:i mean:f", f"""
WITH {EV} SELECT run_id, seq, avg(value) OVER (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean FROM ev""")
def trailing_mean(spark, sf):
    return rolling.rolling_mean(messages(spark, sf), RUN, T, SEQ, "value", 5, full=False)


@query("message_frequency", "run_id:i seq:i frequency:f frequency_mean:f in_band:b", f"""
WITH {EV}, a AS (SELECT *, {float(DAY)} / nullif(t - lag(t) OVER {W}, 0) AS frequency FROM ev),
b AS (SELECT *, CASE WHEN count(frequency) OVER w = 3 THEN avg(frequency) OVER w END AS frequency_mean FROM a
 WINDOW w AS (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT run_id, seq, frequency, frequency_mean, frequency_mean BETWEEN 1 AND 10 AS in_band FROM b""")
def message_frequency(spark, sf):
    out = rolling.message_frequency(messages(spark, sf), RUN, T, SEQ, 3, DAY)
    return out.withColumn("in_band", F.col("frequency_mean").between(1, 10))


@query("sliding_frequency", "run_id:i seq:i n_window:i frequency:f warm:b", f"""
WITH {EV} SELECT run_id, seq, count(*) OVER (PARTITION BY run_id ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n_window,
 n_window / 24.0 AS frequency, t - min(t) OVER (PARTITION BY run_id) >= {DAY} AS warm FROM ev""")
def sliding_frequency(spark, sf):
    return rolling.sliding_frequency(messages(spark, sf), RUN, T, DAY, H)


@query("frequency_bands", "topic:s n:i pct_in_band:f", f"""
WITH {EV}, a AS (SELECT topic, run_id, t, count(*) OVER (PARTITION BY run_id, topic ORDER BY t RANGE BETWEEN {5*DAY} PRECEDING AND CURRENT ROW) / 5.0 AS f,
 t - min(t) OVER (PARTITION BY run_id, topic) >= {5*DAY} AS warm FROM ev)
SELECT topic, count(*) AS n, count(*) FILTER (f BETWEEN 0.3 AND 0.9) * 100.0 / count(*) AS pct_in_band FROM a WHERE warm GROUP BY topic""")
def frequency_bands(spark, sf):
    rows = rolling.sliding_frequency(messages(spark, sf), ["run_id", "topic"], T, 5 * DAY, DAY).where("warm")
    ok = F.col("frequency").between(0.3, 0.9)
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("pct_in_band"))


@query("missing_durations", "run_id:i topic:s t:i missing:i", f"""
WITH {EV}, a AS (SELECT DISTINCT run_id, topic, t FROM ev)
SELECT run_id, topic, t, lead(t) OVER (PARTITION BY run_id, topic ORDER BY t) - t AS missing FROM a""")
def missing_durations(spark, sf):
    return rolling.missing_durations(messages(spark, sf), ["run_id", "topic"], T)


@query("extra_instances", "run_id:i topic:s d:i seq:i", f"""
WITH {EV} SELECT run_id, topic, t // {DAY} AS d, seq FROM ev QUALIFY row_number() OVER (PARTITION BY run_id, topic, t // {DAY} ORDER BY seq) > 1""")
def extra_instances(spark, sf):
    daily = messages(spark, sf).select("run_id", "topic", F.floor(F.col("t") / F.lit(DAY)).alias("d"), "seq")
    return rolling.extra_instances(daily, ["run_id", "topic"], "d", "seq")


@query("fill_gaps", "run_id:i d:i filler:b", f"""
WITH {EV}, a AS (SELECT DISTINCT run_id, t // {DAY} AS d FROM ev),
b AS (SELECT *, lead(d) OVER w AS n1, lead(d, 2) OVER w AS n2 FROM a WINDOW w AS (PARTITION BY run_id ORDER BY d))
SELECT run_id, d, false AS filler FROM a UNION ALL SELECT run_id, d + 1, true FROM b WHERE n1 - d > 1 AND n2 IS NOT NULL""")
def fill_gaps(spark, sf):
    daily = messages(spark, sf).select("run_id", F.floor(F.col("t") / F.lit(DAY)).alias("d"))
    return rolling.fill_gaps(daily, RUN, "d", 1, 0)


@query("change_points", "run_id:i t:i seq:i topic:s previous:s", f"""
WITH {EV}, a AS (SELECT *, lag(topic) OVER {W} AS previous FROM ev) SELECT run_id, t, seq, topic, previous FROM a WHERE previous IS DISTINCT FROM topic""")
def change_points(spark, sf):
    return intervals.change_points(messages(spark, sf), RUN, T, SEQ, "topic")


@query("hysteresis_changes", "run_id:i t:i seq:i value:f", f"""
WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER {W} AS rn FROM ev),
r AS (SELECT run_id, t, seq, rn, value, value AS acc, true AS hit FROM o WHERE rn = 1
 UNION ALL SELECT o.run_id, o.t, o.seq, o.rn, o.value, CASE WHEN abs(o.value - r.acc) > 40 THEN o.value ELSE r.acc END, abs(o.value - r.acc) > 40
 FROM r JOIN o ON o.run_id = r.run_id AND o.rn = r.rn + 1)
SELECT run_id, t, seq, value FROM r WHERE hit""")
def hysteresis_changes(spark, sf):
    return hysteresis.hysteresis_changes(messages(spark, sf), RUN, T, SEQ, "value", 40.0)


@query("ordered_sequence", "run_id:i t_start:i t_end:i", f"""
WITH {EV}, a AS (SELECT *, lag(topic) OVER {W} AS p FROM ev), c AS (SELECT * FROM a WHERE p IS DISTINCT FROM topic),
d AS (SELECT run_id, t, topic, lag(topic) OVER {W} AS b1, lag(topic, 2) OVER {W} AS b2, lag(t, 2) OVER {W} AS t2 FROM c)
SELECT run_id, t2 AS t_start, t AS t_end FROM d WHERE b2 = 'view' AND b1 = 'click' AND topic = 'purchase'""")
def ordered_sequence(spark, sf):
    out = intervals.ordered_sequence(messages(spark, sf), RUN, T, SEQ, "topic", ["view", "click", "purchase"])
    return out.withColumnsRenamed({"start": "t_start", "end": "t_end"})


@query("nth_event", "run_id:i t:i seq:i value:f", f"""
WITH {EV} SELECT run_id, t, seq, value FROM ev WHERE topic = 'purchase' QUALIFY row_number() OVER {W} = 4""")
def nth_event(spark, sf):
    return rolling.nth(messages(spark, sf).where(F.col("topic") == "purchase"), RUN, T, SEQ, 4)


@query("last_before_code_change", "run_id:i t:i seq:i topic:s following:s", f"""
WITH {EV}, a AS (SELECT *, lead(topic) OVER {W} AS following FROM ev) SELECT run_id, t, seq, topic, following FROM a WHERE following <> topic""")
def last_before_code_change(spark, sf):
    o = Ordered.of(messages(spark, sf), RUN, T, SEQ).next(following="topic")
    return o.df.where(F.col("following") != F.col("topic"))


@query("settle_time", "run_id:i t_begin:i t_settled:i n_out:i passed:b", f"""
WITH {EV}, o AS (SELECT run_id, max(t) FILTER (value > 100) AS last_out, min(t) AS t_begin, count(*) FILTER (value > 100) AS n_out FROM ev GROUP BY run_id),
s AS (SELECT o.run_id, min(t) AS t_settled FROM o JOIN ev USING (run_id) WHERE value <= 100 AND (last_out IS NULL OR t > last_out) GROUP BY o.run_id)
SELECT run_id, t_begin, t_settled, n_out, t_settled - t_begin <= {20*DAY} AS passed FROM o LEFT JOIN s USING (run_id)""")
def settle_time(spark, sf):
    out = intervals.settle_time(messages(spark, sf), RUN, T, SEQ, F.col("value") <= 100)
    out = out.withColumnsRenamed({"begin": "t_begin", "settled": "t_settled"})
    return out.withColumn("passed", F.col("t_settled") - F.col("t_begin") <= 20 * DAY)


@query("unwrap", "run_id:i seq:i heading:f unwrapped:f", f"""
WITH {EV}, a AS (SELECT run_id, t, seq, (k * 3.6 + value) - 360 * floor((k * 3.6 + value) / 360) AS heading FROM ev),
b AS (SELECT *, heading - lag(heading) OVER {W} AS d FROM a),
c AS (SELECT *, (d + 180) - 360 * floor((d + 180) / 360) - 180 AS m FROM b),
e AS (SELECT *, CASE WHEN abs(d) >= 270 THEN (CASE WHEN m = -180 AND d > 0 THEN 180 ELSE m END) - d ELSE 0 END AS fix FROM c)
SELECT run_id, seq, heading, heading + sum(fix) OVER {W} AS unwrapped FROM e""")
def unwrap(spark, sf):
    rows = messages(spark, sf).withColumn("heading", F.pmod(F.col("k") * 3.6 + F.col("value"), F.lit(360.0)))
    return rolling.unwrap(rows, RUN, T, SEQ, "heading", 360, 270)


@query("gradient", "run_id:i seq:i gradient:f", f"""
WITH {EV}, a AS (SELECT *, (t - lag(t) OVER w) / {float(DAY)} AS hd, (lead(t) OVER w - t) / {float(DAY)} AS hs,
 value - lag(value) OVER w AS db, lead(value) OVER w - value AS da FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY t, seq))
SELECT run_id, seq, CASE WHEN hd IS NULL THEN da / nullif(hs, 0) WHEN hs IS NULL THEN db / nullif(hd, 0)
 ELSE (hd * (da / nullif(hs, 0)) + hs * (db / nullif(hd, 0))) / nullif(hd + hs, 0) END AS gradient FROM a""")
def gradient(spark, sf):
    return rolling.gradient(messages(spark, sf), RUN, T, SEQ, "value", DAY)


@query("path_length", "run_id:i seq:i step:f downtrack:f", f"""
WITH {EV}, a AS (SELECT *, coalesce(sqrt((value - lag(value) OVER {W}) ** 2 + (k - lag(k) OVER {W}) ** 2), 0) AS step FROM ev)
SELECT run_id, seq, step, sum(step) OVER {W} AS downtrack FROM a""")
def path_length(spark, sf):
    return rolling.path_length(messages(spark, sf), RUN, T, SEQ, "value", "k")


@query("drop_ends", "run_id:i seq:i value:f", f"""
WITH {EV} SELECT run_id, seq, value FROM ev QUALIFY row_number() OVER {W} > 2 AND row_number() OVER (PARTITION BY run_id ORDER BY t DESC, seq DESC) > 1""")
def drop_ends(spark, sf):
    return rolling.drop_ends(messages(spark, sf), RUN, T, SEQ, 2, 1)


@query("minimum_motion", "run_id:i seq:i step:f", f"""
WITH {EV}, a AS (SELECT *, sqrt((value - lag(value) OVER {W}) ** 2 + (k - lag(k) OVER {W}) ** 2) AS step FROM ev)
SELECT run_id, seq, step FROM a WHERE step >= 20""")
def minimum_motion(spark, sf):
    return rolling.path_length(messages(spark, sf), RUN, T, SEQ, "value", "k").where("step >= 20")


@query("debounced_plateau", "run_id:i n_used:i passed:b", f"""
WITH {EV}, a AS (SELECT *, k >= 30 AS top, lag(k >= 30) OVER {W} AS was FROM ev),
b AS (SELECT *, sum(CASE WHEN top AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS isl FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY run_id, isl ORDER BY t, seq) AS rn FROM b WHERE top)
SELECT run_id, count(*) FILTER (rn > 2) AS n_used, bool_and(value < 200) FILTER (rn > 2) AS passed FROM c GROUP BY run_id""")
def debounced_plateau(spark, sf):
    top = F.col("k") >= 30
    o = Ordered.of(messages(spark, sf).withColumn("top", top), RUN, T, SEQ).prev(was="top")
    o = o.islands("isl", F.col("top") & ~F.coalesce("was", F.lit(False)))
    plateaus = Ordered.of(o.df.where("top"), ["run_id", "isl"], T, SEQ).number("rn").df
    used = F.col("rn") > 2
    return plateaus.groupBy("run_id").agg(F.count_if(used).alias("n_used"),
                                          F.bool_and(F.when(used, F.col("value") < 200)).alias("passed"))


@query("turn_segments", "run_id:i segment:i t_start:i t_end:i n:i lowest:f", f"""
WITH {EV}, a AS (SELECT *, k < 60 AS slow, lag(k < 60) OVER {W} AS was, lag(t) OVER {W} AS pt, lead(t) OVER {W} AS nt FROM ev),
b AS (SELECT *, sum(CASE WHEN slow AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER {W} AS segment FROM a)
SELECT run_id, segment, min(t) AS t_start, max(t) AS t_end, count(*) AS n, min(value) AS lowest FROM b WHERE slow GROUP BY run_id, segment
HAVING NOT bool_or(k < 5) AND NOT bool_or(pt IS NULL) AND NOT bool_or(nt IS NULL)""")
def turn_segments(spark, sf):
    rows = Ordered.of(messages(spark, sf), RUN, T, SEQ).prev(pt="t").next(nt="t").df
    out = intervals.runs(rows, RUN, T, SEQ, F.col("k") < 60, lowest=F.min("value"),
                         touched=F.bool_or((F.col("k") < 5) | F.col("pt").isNull() | F.col("nt").isNull()))
    return out.where("not touched").withColumnsRenamed({"seq": "segment", "start": "t_start", "end": "t_end"})


@query("last_increase_before_stop", "run_id:i t_decel:i t_stop:i", f"""
WITH {EV}, a AS (SELECT *, value - lag(value) OVER {W} AS d FROM ev), s AS (SELECT run_id, min(t) FILTER (value < 3) AS t_stop FROM ev GROUP BY run_id)
SELECT run_id, max(t) FILTER (d >= 0 AND t < t_stop) AS t_decel, any_value(t_stop) AS t_stop FROM a JOIN s USING (run_id) GROUP BY run_id""")
def last_increase_before_stop(spark, sf):
    o = Ordered.of(messages(spark, sf), RUN, T, SEQ).prev(pv="value")
    o = o.running(stopped=("min", F.when(F.col("value") < 3, F.col("t"))))
    # rows at or after the stop already see it, so the last earlier rise is known without a second pass
    rise = F.when((F.col("value") - F.col("pv") >= 0) & F.col("stopped").isNull(), F.col("t"))
    out = o.df.groupBy("run_id").agg(F.max(rise).alias("rise"), F.min("stopped").alias("t_stop"))
    return out.withColumn("t_decel", F.when(F.col("t_stop").isNotNull(), F.col("rise")))


@query("rate_over_next", "run_id:i seq:i t_next:i rate:f", f"""
WITH {EV}, a AS (SELECT *, t + {DAY} AS at FROM ev)
SELECT a.run_id, a.seq, r.t AS t_next, (r.value - a.value) / ((r.t - a.t) / {float(H)}) AS rate
FROM a ASOF LEFT JOIN (SELECT run_id, t, min(seq) AS s, arg_min(value, seq) AS value FROM ev GROUP BY run_id, t) r ON a.run_id = r.run_id AND a.at <= r.t""")
def rate_over_next(spark, sf):
    return rates.rate_over_next(messages(spark, sf), RUN, T, SEQ, "value", DAY, H)


@query("section_rate", "run_id:i t_begin:i t_end:i rate:f passed:b", f"""
WITH {EV}, b AS (SELECT run_id, min(t) AS t_begin FROM ev WHERE value < 20 GROUP BY run_id),
e AS (SELECT run_id, min(t) AS t_end FROM ev JOIN b USING (run_id) WHERE value > 80 AND t > t_begin GROUP BY run_id),
v AS (SELECT run_id, t, arg_min(value, seq) FILTER (value < 20) AS lo, arg_min(value, seq) FILTER (value > 80) AS hi FROM ev GROUP BY run_id, t)
SELECT run_id, t_begin, t_end, (y.hi - x.lo) / ((t_end - t_begin) / {float(H)}) AS rate, rate >= 1 AS passed
FROM (SELECT DISTINCT run_id FROM ev) LEFT JOIN b USING (run_id) LEFT JOIN e USING (run_id)
LEFT JOIN v x ON x.run_id = b.run_id AND x.t = t_begin LEFT JOIN v y ON y.run_id = e.run_id AND y.t = t_end""".replace("SELECT run_id, t_begin, t_end, (y", "SELECT b.run_id AS run_id, t_begin, t_end, (y"))
def section_rate(spark, sf):
    out = rates.section_rate(messages(spark, sf), RUN, T, SEQ, "value", F.col("value") < 20, F.col("value") > 80, H)
    return out.withColumn("passed", F.col("rate") >= 1)


@query("point_acceleration", "run_id:i t:i speed:f accel:f", f"""
WITH {EV}, a AS (SELECT * FROM ev WHERE value > 5),
b AS (SELECT run_id, t, seq, CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END AS speed FROM a WINDOW w AS (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
c AS (SELECT * FROM b WHERE speed IS NOT NULL), d AS (SELECT *, lead(speed) OVER {W} AS ns, lead(t) OVER {W} AS nt FROM c)
SELECT run_id, t, speed, (ns - speed) / ((nt - t) / {float(H)}) AS accel FROM d WHERE nt > t""")
def point_acceleration(spark, sf):
    smooth = rolling.rolling_mean(messages(spark, sf).where(F.col("value") > 5), RUN, T, SEQ, "value", 5, centered=True, name="speed")
    o = Ordered.of(smooth.where(F.col("speed").isNotNull()), RUN, T, SEQ).next(ns="speed", nt="t")
    change = (F.col("ns") - F.col("speed")) / ((F.col("nt") - F.col("t")) / F.lit(H))
    return o.df.where(F.col("nt") > F.col("t")).withColumn("accel", change)


@query("relative_time", "run_id:i seq:i t_rel:f value:f", f"""
WITH {EV} SELECT run_id, seq, (t - min(t) OVER (PARTITION BY run_id)) / 1e6 AS t_rel, value FROM ev""")
def relative_time(spark, sf):
    out = rolling.relative_time(messages(spark, sf), RUN, T)
    return out.withColumn("t_rel", F.col("t_rel") / F.lit(1e6))


@query("anchored_windows", "run_id:i slot:i n:i closed:b", f"""
WITH RECURSIVE {EV}, s AS (SELECT run_id, t // {H} AS slot, count(*) AS c FROM ev GROUP BY ALL),
r AS (SELECT run_id, min(slot) AS a FROM s GROUP BY run_id
 UNION ALL (SELECT r.run_id, min(s.slot) FROM r JOIN s ON s.run_id = r.run_id AND s.slot >= r.a + 48 GROUP BY r.run_id, r.a))
SELECT r.run_id, r.a AS slot, sum(s.c) AS n, r.a < max(r.a) OVER (PARTITION BY r.run_id) AS closed
FROM r JOIN s ON s.run_id = r.run_id AND s.slot >= r.a AND s.slot < r.a + 48 GROUP BY r.run_id, r.a""")
def anchored_windows(spark, sf):
    return anchored.anchored_windows(messages(spark, sf), RUN, T, slot=H, length=48).withColumnRenamed("start", "slot")


@query("steady_before_event", "run_id:i t_steady:i t_event:i passed:b", f"""
WITH {EV}, e AS (SELECT run_id, min(t) FILTER (topic = 'purchase') AS t_event FROM ev GROUP BY run_id),
a AS (SELECT run_id, t, t_event, value BETWEEN 5 AND 150 AS ok FROM ev JOIN e USING (run_id) WHERE t <= t_event),
l AS (SELECT run_id, max(t) FILTER (NOT ok) AS last_out FROM a GROUP BY run_id)
SELECT run_id, min(t) FILTER (ok AND (last_out IS NULL OR t > last_out)) AS t_steady, any_value(t_event) AS t_event, t_event - t_steady >= {12*H} AS passed FROM a JOIN l USING (run_id) GROUP BY run_id""".replace("any_value(t_event) AS t_event, t_event - t_steady", "any_value(t_event) AS t_event, any_value(t_event) - min(t) FILTER (ok AND (last_out IS NULL OR t > last_out))"))
def steady_before_event(spark, sf):
    rows = messages(spark, sf)
    o = Ordered.of(rows, RUN, T, SEQ).ahead(t_event=F.when(F.col("topic") == "purchase", F.col("t")))
    o = o.running(seen=("min", F.when(F.col("topic") == "purchase", F.col("t"))))
    before = o.df.where(F.col("seen").isNull() | (F.col("seen") == F.col("t"))).where(F.col("t_event").isNotNull())
    steady = intervals.settle_time(before, RUN, T, SEQ, F.col("value").between(5, 150))
    event = rows.where(F.col("topic") == "purchase").groupBy("run_id").agg(F.min("t").alias("t_event"))
    out = steady.join(event, "run_id").withColumnRenamed("settled", "t_steady")
    return out.withColumn("passed", F.col("t_event") - F.col("t_steady") >= 12 * H)


@query("lane_change_duration", "run_id:i change_no:i t_start:i t_done:i duration:i passed:b", f"""
WITH {EV}, a AS (SELECT *, topic = 'click' AS on_, lag(topic = 'click') OVER {W} AS was FROM ev),
b AS (SELECT run_id, t AS t_start, sum(1) OVER {W} AS change_no FROM a WHERE on_ AND NOT coalesce(was, false)),
c AS (SELECT run_id, t FROM ev WHERE abs(k - 50) < 10)
SELECT b.run_id, change_no, t_start, c.t AS t_done, c.t - t_start AS duration, c.t - t_start <= {5*DAY} AS passed
FROM b ASOF LEFT JOIN (SELECT DISTINCT run_id, t FROM c) c ON b.run_id = c.run_id AND b.t_start <= c.t""")
def lane_change_duration(spark, sf):
    from ...operators.matching import next_after

    rows = messages(spark, sf)
    changes = intervals.state_intervals(rows, RUN, T, SEQ, F.col("topic") == "click", close="last_true")
    starts = changes.select("run_id", F.col("seq").alias("change_no"), F.col("start").alias("t"))
    reached = rows.where(F.abs(F.col("k") - 50) < 10).select("run_id", "t", "seq")
    out = next_after(starts, reached, RUN, T, tie=SEQ, columns=[])
    out = out.withColumnsRenamed({"t": "t_start", "t_next": "t_done", "wait": "duration"})
    return out.withColumn("passed", F.col("duration") <= 5 * DAY)


@query("segment_verdicts", "run_id:i n_segments:i n_passed:i passed:b first_segment:b", f"""{_ENGAGED}, s AS (SELECT run_id, interval_no, bool_and(k < 95) AS ok, max(value) AS top FROM b WHERE engaged GROUP BY run_id, interval_no)
SELECT run_id, count(*) AS n_segments, count(*) FILTER (ok) AS n_passed, bool_and(ok) AS passed, bool_and(ok) FILTER (interval_no = 1) AS first_segment FROM s GROUP BY run_id""")
def segment_verdicts(spark, sf):
    # a metric per stretch of engagement, then one verdict per run; the n-th stretch is a named segment
    spans = intervals.runs(messages(spark, sf), RUN, T, SEQ, F.col("value") >= 30, ok=F.bool_and(F.col("k") < 95))
    return spans.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.count_if("ok").alias("n_passed"), F.bool_and("ok").alias("passed"),
        F.bool_and(F.when(F.col("seq") == 1, F.col("ok"))).alias("first_segment"))


@query("speed_overlay", "run_id:i role:s t_rel:f speed:f commanded:f", f"""
WITH {EV}, e AS (SELECT run_id, min(t) AS t0, max(t) AS t1 FROM ev WHERE k < 90 GROUP BY run_id), c AS (SELECT run_id, t, value AS commanded FROM ev WHERE topic = 'view'),
a AS (SELECT ev.run_id, ev.t, ev.value, t0 FROM ev JOIN e ON ev.run_id = e.run_id AND ev.t BETWEEN t0 AND t1 WHERE topic <> 'view')
SELECT a.run_id, CASE a.run_id % 3 WHEN 0 THEN 'leader' WHEN 1 THEN 'follower' ELSE 'third' END AS role, (a.t - t0) / {float(H)} AS t_rel, a.value * 2.23694 AS speed, coalesce(c.commanded, 0) AS commanded
FROM a ASOF LEFT JOIN c ON a.run_id = c.run_id AND a.t >= c.t""")
def speed_overlay(spark, sf):
    # actual and commanded speed of every vehicle of a test on one relative time axis
    from ...functions.units import mps_to_mph
    from ...operators.asof import last_known

    rows = messages(spark, sf)
    spans = rows.where("k < 90").groupBy("run_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    commands = rows.where("topic = 'view'").select("run_id", "t", "seq", F.col("value").alias("commanded"))
    inside = rows.where("topic <> 'view'").join(spans, "run_id").where(F.col("t").between(F.col("t0"), F.col("t1")))
    joined = last_known(inside, commands, RUN, T, ["commanded"], tie=SEQ, default=0.0)
    place = F.col("run_id") % 3
    role = F.when(place == 0, "leader").when(place == 1, "follower").otherwise("third")
    return joined.select("run_id", role.alias("role"), ((F.col("t") - F.col("t0")) / F.lit(float(H))).alias("t_rel"),
                         mps_to_mph(F.col("value")).alias("speed"), "commanded")


@query("stack_period", "topic:s n:i mean:f sd:f worst:f n_over:i", f"""
WITH {EV}, d AS (SELECT DISTINCT run_id, topic, t FROM ev), g AS (SELECT topic, (lead(t) OVER (PARTITION BY run_id, topic ORDER BY t) - t) / {float(H)} AS gap FROM d)
SELECT topic, count(gap) AS n, avg(gap) AS mean, stddev_pop(gap) AS sd, max(gap) AS worst, count(*) FILTER (gap > 96) AS n_over FROM g GROUP BY topic""")
def stack_period(spark, sf):
    gap = F.col("missing") / F.lit(float(H))
    return rolling.missing_durations(messages(spark, sf), ["run_id", "topic"], T).groupBy("topic").agg(
        F.count("missing").alias("n"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("sd"), F.max(gap).alias("worst"), F.count_if(gap > 96).alias("n_over"))


@query("finite_values", "run_id:i n:i n_void:i mean:f", f"""
WITH {EV} SELECT run_id, count(*) FILTER (k > 4) AS n, count(*) FILTER (k <= 4) AS n_void, avg(value / k) FILTER (k > 4) AS mean FROM ev GROUP BY run_id""")
def finite_values(spark, sf):
    # not-a-number and absent values are counted, never averaged
    ratio = F.when(F.col("k") == 0, F.lit(float("nan"))).when(F.col("k") > 4, F.col("value") / F.col("k"))
    rows = messages(spark, sf).withColumn("ratio", ratio)
    good = F.col("ratio").isNotNull() & ~F.isnan("ratio")
    return rows.groupBy("run_id").agg(F.count_if(good).alias("n"), F.count_if(~good).alias("n_void"), F.avg(F.when(good, F.col("ratio"))).alias("mean"))
