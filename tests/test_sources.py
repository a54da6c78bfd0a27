"""Files in, files out."""

import json

import pytest
from pyspark.sql import functions as F

from roadlog.operators import reshape
from roadlog.sources import logs, sinks, tables


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_topic_dump_over_many_splits(spark, tmp_path):
    records, expected = [], []
    for i in range(200):
        body = json.dumps({"n": i, "pos": {"x": i / 2}}, indent=1 if i % 2 else None)
        records.append(f"CreateTime:{1000 + i}\tkey {body if i % 10 else body[:-1]}\n")
        if i % 10:
            expected.append((1000 + i, i, i / 2))
    path = put(tmp_path, "spat.log", "".join(records))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        dump = logs.read_topic_dump(spark, path)
        assert dump.rdd.getNumPartitions() > 5
        good, bad = logs.parse_topic_dump(dump, "n long, pos struct<x: double>")
        assert sorted(tuple(r) for r in good.select("created_ms", "message.n", "message.pos.x").collect()) == expected
        assert bad.count() == 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_topic_dump_keeps_the_last_record(spark, tmp_path):
    path = put(tmp_path, "one.log", 'CreateTime:5 x {"n": 1}\nCreateTime:6 x {"n": 2}\n')
    good, _ = logs.parse_topic_dump(logs.read_topic_dump(spark, path), "n long")
    assert sorted(r.created_ms for r in good.collect()) == [5, 6]


def test_keyword_log_takes_the_next_line_across_splits(spark, tmp_path, mode):
    lines = []
    for i in range(100):
        lines.append(f"[{i}] plugin.cpp (12) - INFO: Receive BSM: x")
        lines.append(f"<msg>{i}</msg>, stream")
        lines.append(f"[{i}] plugin.cpp (9) - DEBUG: other: y")
    path = put(tmp_path, "rsu.log", "\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = logs.read_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 5
        got = logs.keyword_log(rows, "file", ["block", "line"], "value", ["receive bsm"], ["Receive BSM"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((int(r.time), r.value) for r in got) == [(i, f"<msg>{i}</msg>") for i in range(100)]


def test_item_log_fields_and_names(spark):
    line = "2023 12:00:01 [x] - FER-15: id: abc; port no: 44445; RSU Names: west_1_9f,east_77,"
    rows = spark.createDataFrame([(1, line), (1, "2023 12:00:02 [x] - nothing: here")], "f long, value string")
    got = [(r.time, r.place, r.name, r.value) for r in logs.item_log(rows, ["f"], "value", "fer-15").orderBy("place").collect()]
    assert got == [("12:00:01", 0, "id", "abc"), ("12:00:01", 1, "port_no", "44445"), ("12:00:01", 2, "RSU_Names", "west_1,east")]


def test_real_time_factor_with_carriage_returns(spark):
    text = "Simulating: 100 ns (1s) - RTF: 0.75, ETC: x\rSimulating: 200 ns (2s) - RTF: 1.5, ETC: y\nSimulating: 300 ns stopped\n"
    got = logs.real_time_factors(spark.createDataFrame([(1, text)], "run long, c string"), ["run"], "c")
    assert sorted((r.sim_time_ns, r.rtf) for r in got.collect()) == [(100, 0.75), (200, 1.5)]


def test_csv_with_header_check(spark, tmp_path):
    good = put(tmp_path, "good.csv", "sim_time_ns,rtf\n1,0.5\n2,0.7\n")
    wrong = put(tmp_path, "wrong.csv", "time,rtf\n1,0.5\n")
    bad = put(tmp_path, "bad.csv", "sim_time_ns,rtf\n1,abc\n")
    schema = "sim_time_ns long, rtf double"
    assert tables.read_csv(spark, good, schema, strict=True).count() == 2
    for path in (wrong, bad):
        with pytest.raises(Exception):
            tables.read_csv(spark, path, schema, strict=True).collect()


def test_csv_without_header_and_spaces(spark, tmp_path):
    path = put(tmp_path, "udp.csv", "car,1.5,2\nbus,3.5,x\n")
    assert [tuple(r) for r in tables.read_csv(spark, path, "kind string, x double, id long", header=False).collect()] == [("car", 1.5, 2), ("bus", 3.5, None)]
    text = spark.read.text(put(tmp_path, "gps.txt", "  1   2.5\n3\t4.5 \n"))
    assert [tuple(r) for r in tables.split_spaces(text, "value", {"a": "long", "b": "double"}).collect()] == [(1, 2.5), (3, 4.5)]


def test_json_document_first_location(spark, tmp_path):
    path = put(tmp_path, "sensors.json", json.dumps([{"location": {"x": 1.0, "y": 2.0}}, {"location": {"x": 5.0, "y": 6.0}}], indent=2))
    rows = tables.read_json_document(spark, path, "location struct<x: double, y: double>")
    assert (rows.first().location.x, rows.count()) == (1.0, 2)


def test_grown_columns_are_merged(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, name string").write.parquet(f"{tmp_path}/old")
    spark.createDataFrame([(2, 0.5)], "id long, rate double").write.parquet(f"{tmp_path}/new")
    merged = tables.merged(spark, [f"{tmp_path}/old", f"{tmp_path}/new"])
    assert {r.id: (r.name, r.rate) for r in merged.collect()} == {1: ("a", None), 2: (None, 0.5)}


def test_file_listing_selection_and_newest(spark, tmp_path):
    for name in ("run1_truckA.csv", "run1_truckB.csv", "run2_truckA.csv"):
        put(tmp_path, name, "x")
    files = tables.file_listing(spark, str(tmp_path), "*.csv").select("path", "modificationTime")
    chosen = tables.select_files(files, "path", ["run1"], "truckA")
    assert chosen.count() == 1
    left = tables.select_files(files, "path", [], None, chosen)
    assert left.count() == 2
    assert tables.newest(files.withColumn("g", F.lit(1)), ["g"], "path", "modificationTime").count() == 1


def test_sinks_replace_their_target(spark, tmp_path):
    df = spark.createDataFrame([("/a/b", 1, "m1"), ("/a/c", 2, "m2")], "topic string, n long, metric_id string")
    for _ in range(2):
        sinks.write_csv(df, f"{tmp_path}/csv")
        sinks.write_topics(df, f"{tmp_path}/topics")
        sinks.write_sheets(df, f"{tmp_path}/sheets")
        sinks.write_messages(df.withColumn("run_id", F.lit(1)), f"{tmp_path}/messages", "run_id", "n")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    assert (tmp_path / "topics" / "topic=a_b").is_dir() and (tmp_path / "sheets" / "metric_id=m2").is_dir()
    assert spark.read.parquet(f"{tmp_path}/messages").where("topic = '/a/b'").count() == 1


def test_bucketed_recordings_need_no_shuffle(spark, tmp_path):
    from pyspark.sql import functions as F

    from roadlog.operators.rates import gap_coverage

    df = spark.range(200).select((F.col("id") % 7).alias("run_id"), F.col("id").alias("t"), F.col("id").alias("seq"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rl LOCATION '{tmp_path}/rl'")
    try:
        sinks.save_bucketed(df, "rl.messages", "run_id", "t", 4)
        plan = gap_coverage(spark.table("rl.messages"), "run_id", "t", "seq", 3)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.sql("DROP DATABASE rl CASCADE")


def test_topic_and_time_reach_the_scan(spark):
    from conftest import SF

    import __spark_entry__ as entry

    plan = entry.queries()["topic_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type" in plan and "GreaterThanOrEqual(ts" in plan


def test_failed_table_does_not_stop_the_others(spark, tmp_path):
    spark.createDataFrame([(1, ["x"], None)], "id long, tags array<string>, void string").write.parquet(f"{tmp_path}/src")
    steps = [("src", "one", [("id", "long", "key", "string"), ("tags", "array", "tags", "string")]), ("lost", "two", [("id", "long", "id", "long")]), ("src", "one", [])]
    status = reshape.copy_tables(spark, steps, lambda s, name: s.read.parquet(f"{tmp_path}/{name}"), lambda df, name: df.write.parquet(f"{tmp_path}/{name}"))
    assert [s[0] for s in status] == ["one", "two"] and status[0][1] == "ok" and status[1][1] != "ok"
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/one").collect()] == [("1", '["x"]')]


def test_field_dictionary(spark):
    schema = spark.createDataFrame([], "a long, b struct<c: double, d: array<struct<e: string>>>").schema
    assert reshape.field_dictionary(schema, "/t") == [("/t", "a", "bigint"), ("/t", "b.c", "double"), ("/t", "b.d[].e", "string")]


def test_cut_tables_can_be_cleared(spark):
    import os

    from roadlog import session

    session.clear(spark)
    table = session.cut(spark.range(5))
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 5 and os.path.isdir(folder)
    assert session.clear(spark) == 1 and not os.path.exists(folder)


def test_copy_steps_overlap(spark, tmp_path):
    """Two steps that wait for each other both end, a failing one stops neither, and statuses come in the order of the steps."""
    import threading

    meeting = threading.Barrier(2, timeout=30)

    def read(s, name):
        if name == "lost":
            raise ValueError("no such table\nat all")
        meeting.wait()
        return s.range(3).select(F.col("id").alias("a"))

    mappings = [reshape.Mapping("a", "long", "b", "string")]
    steps = [("one", "x", mappings), ("lost", "y", mappings), ("two", "z", mappings), ("one", "x", mappings)]
    status = reshape.copy_tables(spark, steps, read, lambda df, name: df.write.parquet(f"{tmp_path}/{name}"))
    assert status == [("x", "ok"), ("y", "no such table"), ("z", "ok")]
    assert spark.read.parquet(f"{tmp_path}/z").columns == ["b"]
