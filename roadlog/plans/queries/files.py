"""Queries that go through files: each writes what a table has to the shared folder and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import reshape
from ...session import shared_dir, written
from ...sources import logs, sinks, tables
from ...streaming import tail
from ..registry import EV, load, messages, query
from . import metric_sql
from .logs import DUMP, dump_records
from .metrics import MSG, RUNS, VIEWS, recording, results_of


def _folder(spark, name):
    return written(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


@query("csv_files", "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:f", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def csv_files(spark, sf):
    path, columns = _folder(spark, "csv"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    sinks.write_csv(load(spark, sf, "orders").select(*columns), path)
    return tables.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", strict=True)


@query("topic_folders", "run_id:i t:i seq:i topic:s value:f", f"WITH {EV} SELECT run_id, t, seq, topic, value FROM ev")
def topic_folders(spark, sf):
    path = _folder(spark, "topics")
    sinks.write_topics(messages(spark, sf).withColumn("topic", F.concat(F.lit("/"), "topic")), path)
    return spark.read.parquet(path)


@query("stored_messages", "run_id:i t:i seq:i topic:s value:f", f"WITH {EV} SELECT run_id, t, seq, topic, value FROM ev WHERE topic = 'click'")
def stored_messages(spark, sf):
    path = _folder(spark, "messages")
    sinks.write_messages(messages(spark, sf), path, "run_id", "t")
    return tables.scan(spark.read.parquet(path), ["click"])


@query("metric_sheets", "use_case:s run_id:i metric_id:s value:f verdict:s", metric_sql.use_case_sql("intersection", MSG, VIEWS, RUNS))
def metric_sheets(spark, sf):
    path = _folder(spark, "sheets")
    sinks.write_sheets(results_of(recording(spark, sf), "intersection"), path)
    return spark.read.parquet(path)


@query("dump_files", "created_ms:i run:i type:s x:f y:i", f"""
WITH {EV} SELECT seq AS created_ms, run_id AS run, topic AS type, value AS x, k AS y FROM ev WHERE topic <> 'error'""")
def dump_files(spark, sf):
    path = _folder(spark, "dump")
    dump_records(spark, sf).select(F.concat(F.lit(logs.MARK), "record").alias("value")).write.text(path)
    good, _ = logs.parse_topic_dump(logs.read_topic_dump(spark, path), DUMP)
    return good.select("created_ms", "message.run", "message.type", "message.pos.x", "message.pos.y")


@query("log_files", "title:s value:s", f"""
WITH {EV}, l AS (SELECT *, lead(seq) OVER (PARTITION BY topic ORDER BY run_id, t, seq) AS nseq FROM ev)
SELECT 'Receive BSM' AS title, ' <BasicSafetyMessage>' || nseq AS value FROM l WHERE k >= 30
UNION ALL SELECT 'Sent', CAST(seq AS VARCHAR) FROM l WHERE k < 30""")
def log_files(spark, sf):
    # a file per topic, its lines by run and time; the place of a line is its split and its number in it
    path = _folder(spark, "lines")
    title = F.when(F.col("k") >= 30, "Receive BSM: x").otherwise(F.concat(F.lit("Sent: "), F.col("seq").cast("string")))
    line = F.concat(F.lit("[now] plugin - INFO: "), title, F.lit(" : a : <BasicSafetyMessage>"), F.col("seq").cast("string"), F.lit(": z"))
    rows = messages(spark, sf).select("topic", "run_id", "t", "seq", line.alias("value"))
    rows.repartition("topic").sortWithinPartitions("topic", "run_id", "t", "seq").select("topic", "value").write.partitionBy("topic").text(path)
    return logs.keyword_log(logs.read_lines(spark, path), "file", ["block", "line"], "value", ["Receive BSM", "Sent"], ["Receive BSM"])


@query("copy_steps", "target:s status:s n:i", """
SELECT 'people' AS target, 'ok' AS status, count(*) AS n FROM customer UNION ALL SELECT 'lands', 'ok', count(*) FROM nation
UNION ALL SELECT 'nowhere', 'failed', 0 FROM region WHERE r_regionkey = 0""")
def copy_steps(spark, sf):
    path = _folder(spark, "copies")
    steps = [("customer", "people", [("c_custkey", "long", "id", "long"), ("c_name", "string", "name", "string")]), ("absent", "nowhere", []),
             ("nation", "lands", [("n_nationkey", "long", "id", "long")]), ("nation", "lands", [("n_name", "string", "name", "string")])]
    mapped = [(a, b, [reshape.Mapping(*m) for m in c]) for a, b, c in steps]
    done = reshape.copy_tables(spark, mapped, lambda s, name: load(s, sf, name), lambda df, target: df.write.parquet(f"{path}/{target}"))
    out = None
    for target, status in done:
        rows = spark.read.parquet(f"{path}/{target}").agg(F.count(F.lit(1)).alias("n")) if status == "ok" else load(spark, sf, "region").where("r_regionkey = 0").select(F.lit(0).alias("n"))
        one = rows.select(F.lit(target).alias("target"), F.lit("ok" if status == "ok" else "failed").alias("status"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("tailed_steps", "source:s sim_time:i system_time:i", f"WITH {EV} SELECT topic AS source, t // 1000 AS sim_time, seq AS system_time FROM ev WHERE k >= 10")
def tailed_steps(spark, sf):
    path = _folder(spark, "tail")
    good = F.concat(F.lit("x Simulation Time: "), F.floor(F.col("t") / 1000).cast("string"), F.lit(" where current system time is: "), F.col("seq").cast("string"))
    rows = messages(spark, sf).select("topic", F.when(F.col("k") >= 10, good).otherwise("Simulation Time: none").alias("value"))
    rows.write.partitionBy("topic").text(path)
    return tail.replay(tail.tail_steps(spark, f"{path}/*", F.regexp_extract("file", "topic=([a-z]+)", 1), []))
