"""Queries of the aggregation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import stats
from ...operators.ordered import Ordered
from ..registry import DAY, EV, H, load, messages, query

RUN, T, SEQ = ["run_id"], "t", ["seq"]


@query("group_stats", "l_returnflag:s l_linestatus:s mean:f min:f median:f max:f std:f count:i", """
SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS mean, min(l_extendedprice) AS min, quantile_cont(l_extendedprice, 0.5) AS median,
 max(l_extendedprice) AS max, stddev_samp(l_extendedprice) AS std, count(l_extendedprice) AS count FROM lineitem GROUP BY ALL""")
def group_stats(spark, sf):
    return stats.group_stats(load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("describe", "topic:s count:i mean:f std:f min:f q25:f q50:f q75:f max:f", f"""
WITH {EV} SELECT topic, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25,
 quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM ev GROUP BY topic""")
def describe(spark, sf):
    return stats.describe(messages(spark, sf), "topic", "value")


@query("series_stats", "count:i mean:f std:f min:f q25:f q50:f q75:f max:f", """
SELECT count(o_totalprice) AS count, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min,
 quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75, max(o_totalprice) AS max FROM orders""")
def series_stats(spark, sf):
    return stats.describe(load(spark, sf, "orders"), [], "o_totalprice")


@query("pass_share", "run_id:i mean:f sd:f pct_under:f passed:b", f"""
WITH {EV} SELECT run_id, avg(value) AS mean, stddev_pop(value) AS sd, count(*) FILTER (value < 110) * 100.0 / count(value) AS pct_under,
 count(*) FILTER (value < 110) * 100.0 / count(value) >= 90 AS passed FROM ev GROUP BY run_id""")
def pass_share(spark, sf):
    return stats.pass_share(messages(spark, sf), RUN, "value", 110)


@query("class_shares", "run_id:i n_negative:i n_below:i n_above:i n_ok:i pct_ok:f lowest:f highest:f", f"""
WITH {EV}, a AS (SELECT run_id, value - k AS gap FROM ev)
SELECT run_id, count(*) FILTER (gap < 0) AS n_negative, count(*) FILTER (gap >= 0 AND gap < 20) AS n_below, count(*) FILTER (gap > 30) AS n_above,
 count(*) FILTER (gap BETWEEN 20 AND 30) AS n_ok, count(*) FILTER (gap BETWEEN 20 AND 30) * 100.0 / count(*) AS pct_ok,
 min(gap) FILTER (gap >= 0 AND gap < 20) AS lowest, max(gap) FILTER (gap > 30) AS highest FROM a GROUP BY run_id""")
def class_shares(spark, sf):
    gap = F.col("value") - F.col("k")
    below, above, ok = (gap >= 0) & (gap < 20), gap > 30, gap.between(20, 30)
    return messages(spark, sf).groupBy("run_id").agg(
        F.count_if(gap < 0).alias("n_negative"), F.count_if(below).alias("n_below"), F.count_if(above).alias("n_above"),
        F.count_if(ok).alias("n_ok"), (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("pct_ok"),
        F.min(F.when(below, gap)).alias("lowest"), F.max(F.when(above, gap)).alias("highest"))


@query("distinct_rows", "l_suppkey:i l_partkey:i", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def distinct_rows(spark, sf):
    return load(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()


@query("histogram_fixed", "topic:s bin:i n:i", f"WITH {EV} SELECT topic, floor(value / 10) * 10 AS bin, count(*) AS n FROM ev GROUP BY ALL")
def histogram_fixed(spark, sf):
    return stats.histogram(messages(spark, sf), "topic", "value", 10)


@query("histogram_bins", "l_returnflag:s slot:i n:i", """
WITH e AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY ALL)
SELECT l_returnflag, least(9, floor((l_quantity - lo) * 10 / (hi - lo))) AS slot, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL""")
def histogram_bins(spark, sf):
    return stats.histogram_bins(load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", 10)


@query("universal_check", "run_id:i all_low:b some_high:b", f"""
WITH {EV} SELECT run_id, bool_and(value < 300) AS all_low, bool_or(value > 200) AS some_high FROM ev GROUP BY run_id""")
def universal_check(spark, sf):
    return messages(spark, sf).groupBy("run_id").agg(F.bool_and(F.col("value") < 300).alias("all_low"), F.bool_or(F.col("value") > 200).alias("some_high"))


@query("first_last_event", "run_id:i t_first:i v_first:f t_last:i v_last:f", f"""
WITH {EV}, a AS (SELECT * FROM ev WHERE value > 50) SELECT run_id, min(t) AS t_first, first(value ORDER BY t, seq) AS v_first, max(t) AS t_last, last(value ORDER BY t, seq) AS v_last FROM a GROUP BY run_id""")
def first_last_event(spark, sf):
    order = F.struct("t", "seq")
    return messages(spark, sf).where("value > 50").groupBy("run_id").agg(
        F.min("t").alias("t_first"), F.min_by("value", order).alias("v_first"), F.max("t").alias("t_last"), F.max_by("value", order).alias("v_last"))


@query("extreme_rows", "run_id:i seq_low:i low:f seq_high:i high:f", f"""
WITH {EV} SELECT run_id, first(seq ORDER BY value, seq) AS seq_low, min(value) AS low, first(seq ORDER BY value DESC, seq) AS seq_high, max(value) AS high FROM ev GROUP BY run_id""")
def extreme_rows(spark, sf):
    return messages(spark, sf).groupBy("run_id").agg(
        F.min_by("seq", F.struct("value", "seq")).alias("seq_low"), F.min("value").alias("low"),
        F.max_by("seq", F.struct(F.col("value"), -F.col("seq"))).alias("seq_high"), F.max("value").alias("high"))


@query("largest_gap", "run_id:i gap:i t_from:i", f"""
WITH {EV}, a AS (SELECT run_id, t - lag(t) OVER w AS gap, lag(t) OVER w AS t_from FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY t, seq))
SELECT run_id, max(gap) AS gap, first(t_from ORDER BY gap DESC, t_from) AS t_from FROM a WHERE gap IS NOT NULL GROUP BY run_id""")
def largest_gap(spark, sf):
    o = Ordered.of(messages(spark, sf), RUN, T, SEQ).prev(t_from="t").with_columns(gap=F.col("t") - F.col("t_from"))
    return o.df.where("gap is not null").groupBy("run_id").agg(
        F.max("gap").alias("gap"), F.max_by("t_from", F.struct(F.col("gap"), -F.col("t_from"))).alias("t_from"))


@query("share_of_entities", "l_linestatus:s n_entities:i mean_of_means:f pct_over:f", """
WITH a AS (SELECT l_linestatus, l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL)
SELECT l_linestatus, count(*) AS n_entities, avg(m) AS mean_of_means, count(*) FILTER (m > 25.5) * 100.0 / count(*) AS pct_over FROM a GROUP BY ALL""")
def share_of_entities(spark, sf):
    return stats.share_of_entities(load(spark, sf, "lineitem"), "l_suppkey", "l_linestatus", "l_quantity", 25.5)


@query("pivot_parts", "run_id:i click:i view:i signup:i purchase:i error:i", f"""
WITH {EV} SELECT run_id, min(t) FILTER (topic = 'click') AS click, min(t) FILTER (topic = 'view') AS view, min(t) FILTER (topic = 'signup') AS signup,
 min(t) FILTER (topic = 'purchase') AS purchase, min(t) FILTER (topic = 'error') AS error FROM ev GROUP BY run_id""")
def pivot_parts(spark, sf):
    from ...operators.reshape import pivot_first

    return pivot_first(messages(spark, sf), RUN, "topic", ["click", "view", "signup", "purchase", "error"], "t")


@query("weighted_spread", "topic:s mean:f sd:f", f"""
WITH {EV}, a AS (SELECT topic, sum(k) AS sw, sum(k * k) AS sw2, sum(k * value) AS swx, sum(k * value * value) AS swx2 FROM ev GROUP BY topic)
SELECT topic, swx / sw AS mean, sqrt((swx2 - swx * swx / sw) / (sw - sw2 / sw)) AS sd FROM a""")
def weighted_spread(spark, sf):
    return stats.weighted_spread(messages(spark, sf), "topic", "value", "k")


@query("box_numbers", "l_suppkey:i n:i low:f q25:f q50:f q75:f high:f", """
SELECT l_suppkey, count(*) AS n, min(x) AS low, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, max(x) AS high
FROM (SELECT l_suppkey, abs(l_extendedprice - 40000) AS x FROM lineitem) GROUP BY ALL""")
def box_numbers(spark, sf):
    return stats.box_numbers(load(spark, sf, "lineitem"), "l_suppkey", F.abs(F.col("l_extendedprice") - 40000))


@query("class_counts", "run_id:i n_light:i n_siren:i n_both:i n_neither:i", f"""
WITH {EV} SELECT run_id, count(*) FILTER (k < 50) AS n_light, count(*) FILTER (value < 30) AS n_siren, count(*) FILTER (k < 50 AND value < 30) AS n_both,
 count(*) FILTER (k >= 50 AND value >= 30) AS n_neither FROM ev GROUP BY run_id""")
def class_counts(spark, sf):
    light, siren = F.col("k") < 50, F.col("value") < 30
    return stats.class_counts(messages(spark, sf), RUN, n_light=light, n_siren=siren, n_both=light & siren, n_neither=~light & ~siren)


@query("ordered_distinct", "run_id:i k:i t_first:i place:i", f"""
WITH {EV}, a AS (SELECT run_id, k, min(t) AS t_first FROM ev GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t_first, k) AS place FROM a""")
def ordered_distinct(spark, sf):
    return stats.ordered_distinct(messages(spark, sf), RUN, "k", T)


@query("detection_frequency", "run_id:i frequency:f pct_fast:f", f"""
WITH {EV}, d AS (SELECT DISTINCT run_id, t FROM ev), g AS (SELECT run_id, (t - lag(t) OVER (PARTITION BY run_id ORDER BY t)) / {float(H)} AS gap FROM d)
SELECT run_id, 1 / avg(gap) AS frequency, count(*) FILTER (gap < 12) * 100.0 / count(gap) AS pct_fast FROM g GROUP BY run_id""")
def detection_frequency(spark, sf):
    seen = messages(spark, sf).select("run_id", "t").distinct()
    o = Ordered.of(seen, RUN, T).prev(pt="t").with_columns(gap=(F.col("t") - F.col("pt")) / F.lit(float(H)))
    return o.df.groupBy("run_id").agg(F.try_divide(F.lit(1.0), F.avg("gap")).alias("frequency"),
                                      F.try_divide(F.count_if(F.col("gap") < 12) * 100.0, F.count("gap")).alias("pct_fast"))


@query("measurement_time_bins", "bin:i n:i", f"""
WITH {EV}, g AS (SELECT (t - lag(t) OVER (PARTITION BY run_id ORDER BY t, seq)) / {float(H)} AS gap FROM ev)
SELECT floor(gap / 10) * 10 AS bin, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL""")
def measurement_time_bins(spark, sf):
    from ...operators.rates import with_gap

    gaps = with_gap(messages(spark, sf), RUN, T, SEQ).where("gap is not null")
    return stats.histogram(gaps, [], F.col("gap") / F.lit(float(H)), 10)


@query("daily_counts", "run_id:i slot:i n:i", f"WITH {EV} SELECT run_id, t // {DAY} AS slot, count(*) AS n FROM ev GROUP BY ALL")
def daily_counts(spark, sf):
    from ...operators.rolling import second_rows

    return second_rows(messages(spark, sf), RUN, T, DAY)
