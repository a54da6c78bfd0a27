"""Queries of the scan and text-log family. The log text is built from the tables row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import quality
from ...sources import logs, tables
from ..registry import DAY, EV, load, messages, micros, query

T0 = 1704067200000000     # 2024-01-01 in microseconds


@query("topic_scan", "run_id:i t:i seq:i topic:s value:f", f"""
WITH {EV} SELECT run_id, t, seq, topic, value FROM ev WHERE topic IN ('click', 'view') AND t BETWEEN {T0 + 5 * DAY} AND {T0 + 20 * DAY}""")
def topic_scan(spark, sf):
    # the bounds are on the stored time, so topic and time both reach the file scan
    stored = load(spark, sf, "events").withColumnRenamed("event_type", "topic")
    first, last = (F.lit(day).cast("timestamp_ntz") for day in ("2024-01-06 00:00:00", "2024-01-21 00:00:00"))
    hits = tables.scan(stored, ["click", "view"], first, last, t="ts")
    return hits.select(F.col("user_id").alias("run_id"), micros("ts").alias("t"), F.col("event_id").alias("seq"), "topic", "value")


@query("topic_inventory", "run_id:i topic:s n:i", f"WITH {EV} SELECT run_id, topic, count(*) AS n FROM ev GROUP BY ALL")
def topic_inventory(spark, sf):
    return tables.topic_counts(messages(spark, sf), ["run_id"])


def dump_records(spark, sf):
    rows = messages(spark, sf)
    body = F.concat(F.lit('{"run": '), F.col("run_id").cast("string"), F.lit(',\n  "type": "'), "topic", F.lit('",\n  "pos": {"x": '),
                    F.col("value").cast("string"), F.lit(', "y": '), F.col("k").cast("string"), F.lit("}}"))
    broken = F.when(F.col("topic") == "error", F.expr("substring(body, 1, length(body) - 2)")).otherwise(F.col("body"))
    return rows.withColumn("body", body).select("run_id", F.concat(F.lit(":"), F.col("seq").cast("string"), F.lit("\tkey:null "), broken, F.lit("\n")).alias("record"))


DUMP = "run long, type string, pos struct<x: double, y: long>"


@query("topic_dump", "created_ms:i run:i type:s x:f y:i", f"""
WITH {EV} SELECT seq AS created_ms, run_id AS run, topic AS type, value AS x, k AS y FROM ev WHERE topic <> 'error'""")
def topicdump_records(spark, sf):
    good, _ = logs.parse_topic_dump(dump_records(spark, sf), DUMP)
    return good.select("created_ms", "message.run", "message.type", "message.pos.x", "message.pos.y")


@query("skipped_records", "run_id:i n_good:i n_skipped:i", f"""
WITH {EV} SELECT run_id, count(*) FILTER (topic <> 'error') AS n_good, count(*) FILTER (topic = 'error') AS n_skipped FROM ev GROUP BY run_id""")
def skipped_records(spark, sf):
    good, bad = logs.parse_topic_dump(dump_records(spark, sf), DUMP)
    return quality.bad_share(good, bad, ["run_id"])


@query("keyword_log", "conv_id:i turn:i time:s title:s value:s", r"""
WITH l AS (SELECT conv_id, turn, role, text, '[2024-01-01 ' || turn || '] plugin - INFO: ' || CASE role WHEN 'user' THEN 'Receive BSM' WHEN 'assistant' THEN 'Sent' ELSE 'Other' END
  || ': ' || replace(replace(text, ':', ';'), ' - ', ' ') AS line FROM conversations),
n AS (SELECT *, lead(line) OVER (PARTITION BY conv_id ORDER BY turn, line) AS nx FROM l)
SELECT conv_id, turn, '2024-01-01 ' || turn AS time, CASE role WHEN 'user' THEN 'Receive BSM' ELSE 'Sent' END AS title,
 trim(regexp_replace(trim(CASE WHEN role = 'user' THEN nx ELSE trim(replace(replace(text, ':', ';'), ' - ', ' ')) END, E' \t\n\r'), E'stream|["\n,]', '', 'g')) AS value FROM n WHERE role IN ('user', 'assistant')""")
def keyword_log(spark, sf):
    title = F.when(F.col("role") == "user", "Receive BSM").when(F.col("role") == "assistant", "Sent").otherwise("Other")
    plain = F.replace(F.replace("text", F.lit(":"), F.lit(";")), F.lit(" - "), F.lit(" "))
    line = F.concat(F.lit("[2024-01-01 "), F.col("turn").cast("string"), F.lit("] plugin - INFO: "), title, F.lit(": "), plain)
    lines = load(spark, sf, "conversations").select("conv_id", "turn", line.alias("line"))
    out = logs.keyword_log(lines.withColumn("tie", F.col("line")), "conv_id", ["turn", "tie"], "line", ["receive bsm", "SENT"], ["Receive BSM"])
    return out


@query("item_log", "event_id:i time:s place:i name:s value:s", f"""
WITH {EV} SELECT seq AS event_id, 't' || k AS time, 0 AS place, 'msg_id' AS name, CAST(seq AS VARCHAR) AS value FROM ev WHERE topic IN ('click', 'view')
UNION ALL SELECT seq, 't' || k, 1, 'speed', CAST(k AS VARCHAR) FROM ev WHERE topic IN ('click', 'view')
UNION ALL SELECT seq, 't' || k, 2, 'RSU_Names', 'a_b,c' FROM ev WHERE topic IN ('click', 'view')""")
def item_log(spark, sf):
    rows = messages(spark, sf)
    tag = F.when(F.col("topic").isin("click", "view"), "FER-13").otherwise("OTHER")
    line = F.concat(F.lit("2024 t"), F.col("k").cast("string"), F.lit(" x - "), tag, F.lit(": msg id: "), F.col("seq").cast("string"), F.lit("; speed:"),
                    F.col("k").cast("string"), F.lit("; RSU Names: a_b_9x,c_77,"))
    return logs.item_log(rows.select(F.col("seq").alias("event_id"), line.alias("line")), ["event_id"], "line", "fer-13")


def _cloud_lines(spark, sf):
    head = F.concat(F.lit("2024 t"), F.col("k").cast("string"), F.lit(" x - "))
    seq, k = F.col("seq").cast("string"), F.col("k").cast("string")
    text = (F.when(F.col("topic") == "click", F.concat(F.lit("Received: BSMRequest [v2xhub_port=4444"), (F.col("k") % 3 + 4).cast("string"), F.lit(",id="), seq, F.lit(",x=1]")))
            .when(F.col("topic") == "view", F.concat(F.lit("FER-14: number of RSUs: "), k, F.lit("; FER-14: RSU Names: a_b_1,c_2,")))
            .when(F.col("topic") == "purchase", F.concat(F.lit("FER-15: sent to V2xHub: "), seq, F.lit(" to port : 44445!")))
            .otherwise(F.lit("IGNORE already Processed BSM: x")))
    return messages(spark, sf).select("run_id", F.col("seq").alias("event_id"), F.concat(head, text).alias("line"))


@query("cloud_request_log", "event_id:i time:s place:i name:s value:s", f"""
WITH {EV} SELECT seq AS event_id, 't' || k AS time, 0 AS place, 'v2xhub_port' AS name, '4444' || (k % 3 + 4) AS value FROM ev WHERE topic = 'click'
UNION ALL SELECT seq, 't' || k, 0, 'Received: BSMRequest', CAST(seq AS VARCHAR) FROM ev WHERE topic = 'click'""")
def cloud_request_log(spark, sf):
    return logs.item_log(_cloud_lines(spark, sf).drop("run_id"), ["event_id"], "line", logs.RECEIVED)


@query("cloud_sent_log", "event_id:i time:s place:i name:s value:s", f"""
WITH {EV} SELECT seq AS event_id, 't' || k AS time, 0 AS place, 'sent_to_V2xHub' AS name, CAST(seq AS VARCHAR) || '  ' AS value FROM ev WHERE topic = 'purchase'
UNION ALL SELECT seq, 't' || k, 0, 'port', '44445' FROM ev WHERE topic = 'purchase'""")
def cloud_sent_log(spark, sf):
    return logs.item_log(_cloud_lines(spark, sf).drop("run_id"), ["event_id"], "line", "FER-15")


@query("cloud_counts", "run_id:i n_received:i n_ignored:i n_identified:i n_sent:i n_units:i", f"""
WITH {EV} SELECT run_id, count(*) FILTER (topic = 'click') AS n_received, count(*) FILTER (topic IN ('error', 'signup')) AS n_ignored, count(*) FILTER (topic = 'view') AS n_identified,
 count(*) FILTER (topic = 'purchase') AS n_sent, coalesce(sum(k) FILTER (topic = 'view'), 0) AS n_units FROM ev GROUP BY run_id""")
def cloud_counts(spark, sf):
    return logs.cloud_counts(_cloud_lines(spark, sf), ["run_id"], "line")


@query("roadside_log", "run_id:i event_id:i title:s value:s", f"""
WITH {EV}, l AS (SELECT *, lead(seq) OVER w AS nseq FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY t, seq))
SELECT run_id, seq AS event_id, 'Receive BSM' AS title, ' <BasicSafetyMessage>' || nseq AS value FROM l WHERE topic = 'click'
UNION ALL SELECT run_id, seq, 'Forwarding message to cloud via curl', '<BSMRequest>' || seq FROM l WHERE topic = 'view' AND k >= 50""")
def roadside_log(spark, sf):
    # every line ends with what a body line has, so that the line after a title is one
    body = F.concat(F.lit(" : a : <BasicSafetyMessage>"), F.col("seq").cast("string"), F.lit(": z"))
    curl = F.concat(F.when(F.col("k") >= 50, "<BSMRequest>").otherwise("<Other>"), F.col("seq").cast("string"))
    head = F.when(F.col("topic") == "click", F.lit("Receive BSM: x")).when(F.col("topic") == "view", F.concat(F.lit("Forwarding message to cloud via curl: "), curl)).otherwise("Other: y")
    rows = messages(spark, sf).select("run_id", "t", F.col("seq").alias("event_id"), F.concat(F.lit("[now] plugin - INFO: "), head, body).alias("line"))
    return logs.keyword_log(rows, "run_id", ["t", "event_id"], "line", ["Receive BSM", "Forwarding message to cloud via curl"], ["Receive BSM"])


@query("fixed_offset_log", "o_orderkey:i time:s reqid:s msgnum:s", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS time, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS reqid, substr(o_orderpriority, 1, 1) AS msgnum FROM orders""")
def fixed_offset_log(spark, sf):
    line = F.concat(F.lit("[INFO] "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" <reqid>"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("</reqid>#"), "o_orderpriority")
    lines = load(spark, sf, "orders").select("o_orderkey", line.alias("line"))
    return logs.fixed_fields(lines, ["o_orderkey"], "line", {"time": (7, 17), "reqid": (25, 33), "msgnum": (42, 43)})


@query("request_part_times", "o_custkey:i p1:s p2:s p3:s p4:s p5:s", """
SELECT o_custkey, min(d) FILTER (p = '1') AS p1, min(d) FILTER (p = '2') AS p2, min(d) FILTER (p = '3') AS p3, min(d) FILTER (p = '4') AS p4, min(d) FILTER (p = '5') AS p5
FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS d, substr(o_orderpriority, 1, 1) AS p FROM orders) GROUP BY o_custkey""")
def request_part_times(spark, sf):
    from ...operators.reshape import pivot_first

    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), "o_orderpriority")
    rows = logs.fixed_fields(load(spark, sf, "orders").select("o_custkey", line.alias("line")), ["o_custkey"], "line", {"time": (0, 10), "part": (11, 12)})
    out = pivot_first(rows, "o_custkey", "part", ["1", "2", "3", "4", "5"], "time")
    return out.withColumnsRenamed({str(i): f"p{i}" for i in range(1, 6)})


@query("csv_fields", "event_id:i run_id:i topic:s value:f", f"WITH {EV} SELECT seq AS event_id, run_id, topic, value FROM ev")
def csv_fields(spark, sf):
    text = F.to_csv(F.struct("seq", "run_id", "topic", "value"))
    rows = messages(spark, sf).select(text.alias("line"))
    return rows.select(F.from_csv("line", "event_id long, run_id long, topic string, value double").alias("r")).select("r.*")


@query("space_separated", "event_id:i run_id:i value:f bad:i", f"WITH {EV} SELECT seq AS event_id, run_id, value, CAST(NULL AS BIGINT) AS bad FROM ev")
def space_separated(spark, sf):
    line = F.concat(F.lit("  "), F.col("seq").cast("string"), F.lit("\t "), F.col("run_id").cast("string"), F.lit("   "), F.col("value").cast("string"), F.lit(" "), "topic")
    return tables.split_spaces(messages(spark, sf).select(line.alias("line")), "line", {"event_id": "long", "run_id": "long", "value": "double", "bad": "long"})


@query("real_time_factors", "run_id:i sim_time_ns:i rtf:f", f"""
WITH {EV} SELECT run_id, t * 1000 AS sim_time_ns, value AS rtf FROM ev WHERE topic <> 'error' UNION ALL SELECT run_id, t * 1000 + 1, k FROM ev WHERE topic <> 'error'""")
def real_time_factors(spark, sf):
    one = lambda shift, r: F.concat(F.lit("Simulating: "), (F.col("t") * 1000 + shift).cast("string"), F.lit(" ns (x s) - RTF: "), r.cast("string"), F.lit(", ETC: 5 s\r"))
    text = F.when(F.col("topic") == "error", F.lit("Simulating: 12 ns - stopped\r")).otherwise(F.concat(one(0, F.col("value")), one(1, F.col("k"))))
    return logs.real_time_factors(messages(spark, sf).select("run_id", text.alias("console")), ["run_id"], "console")


@query("rtf_summary", "run_id:i mean:f passed:b", f"""
WITH {EV} SELECT run_id, avg(value / 100) AS mean, avg(value / 100) >= 0.5 AS passed FROM ev GROUP BY run_id""")
def rtf_summary(spark, sf):
    text = F.concat(F.lit("Simulating: "), F.col("t").cast("string"), F.lit(" ns RTF: "), F.col("value").cast("string"), F.lit(", ETC"))
    rtf = logs.real_time_factors(messages(spark, sf).select("run_id", text.alias("console")), ["run_id"], "console")
    return rtf.groupBy("run_id").agg(F.avg(F.col("rtf") / 100).alias("mean")).withColumn("passed", F.col("mean") >= 0.5)


@query("step_log", "source:s sim_time:i system_time:i", f"WITH {EV} SELECT topic AS source, t // 1000 AS sim_time, seq AS system_time FROM ev WHERE k >= 10")
def step_log(spark, sf):
    good = F.concat(F.lit("x Simulation Time: "), F.floor(F.col("t") / 1000).cast("string"), F.lit(" where current system time is: "), F.col("seq").cast("string"))
    line = F.when(F.col("k") >= 10, good).otherwise("Simulation Time: none")
    return logs.step_lines(messages(spark, sf).select(F.col("topic").alias("source"), line.alias("line")), ["source"], "line")


@query("file_selection", "url:s", """
SELECT url FROM pages WHERE contains(url, 'example') AND contains(url, '/en/') AND page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def file_selection(spark, sf):
    pages = load(spark, sf, "pages")
    excluded = pages.join(load(spark, sf, "labels").where("toxic = 1"), F.col("page_id") == F.col("doc_id"), "left_semi")
    chosen = pages.join(excluded.select("page_id"), "page_id", "left_anti")
    return tables.select_files(chosen.select("url"), "url", ["example"], "/en/")


@query("newest_file", "host:s url:s page_id:i", r"""
WITH a AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url, page_id FROM pages) SELECT host, url, page_id FROM a QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id DESC) = 1""")
def newest_file(spark, sf):
    pages = load(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url", "page_id")
    return tables.newest(pages, ["host"], "url", "page_id")


@query("unescaped_text", "page_id:i n_open:i n_chars:i", """
SELECT page_id, len(html) - len(replace(html, '<', '')) AS n_open, len(replace(html, chr(92), '"')) AS n_chars FROM pages""")
def unescaped_text(spark, sf):
    from ...functions.text import unescape

    escaped = F.replace(F.replace("html", F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
    plain = load(spark, sf, "pages").select("page_id", unescape(escaped).alias("p"))
    return plain.select("page_id", (F.length("p") - F.length(F.replace("p", F.lit("<"), F.lit("")))).alias("n_open"), F.length("p").alias("n_chars"))


@query("keyword_documents", "doc_id:i n_lines:i n_hits:i", """
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' the ') AND NOT contains(x, ' of '))) AS n_hits FROM documents""")
def keyword_documents(spark, sf):
    lines = F.split("text", "\n")
    hit = lambda x: x.contains(" the ") & ~x.contains(" of ")
    return load(spark, sf, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.size(F.filter(lines, hit)).alias("n_hits"))
