"""Streams over several files against the batch result."""

from pyspark.sql import functions as F

from roadlog.streaming import sync, tail


def test_step_logs_as_a_stream_equal_the_batch(spark, tmp_path):
    tools = ("sim", "roads", "net")
    for tool in tools:
        lines = [f"[x] Simulation Time: {s} where current system time is: {10_000 + s * 3 + 4 * i + (9_000 if (s, tool) == (500, 'net') else 0)}"
                 for i, s in enumerate(range(0, 1000, 100)) if not (tool == "roads" and s == 800)]
        (tmp_path / f"{tool}.log").write_text("\n".join(["noise", *lines, lines[0]]) + "\n")
    component = F.regexp_extract("file", r"([a-z]+)\.log$", 1)
    stream = tail.tail_steps(spark, str(tmp_path), component, [F.lit(1).alias("run")])
    live = tail.replay(sync.sync_check_stream(stream, "run", len(tools)), wall_clock=True).where("not incomplete")
    rows = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("file"), "value")
    from roadlog.sources.logs import step_lines

    steps = step_lines(rows.select(F.lit(1).alias("run"), component.alias("source"), "value"), ["run", "source"], "value")
    batch = sync.sync_check(steps, "run", len(tools))
    columns = ["run", "sim_time", "first_next", "last_here", "lag", "synced"]
    got = sorted(tuple(r) for r in live.select(*columns).collect())
    assert got == sorted(tuple(r) for r in batch.select(*columns).collect())
    assert [r[1] for r in got] == [0, 100, 200, 300, 400, 500, 600] and [r[1] for r in got if not r[5]] == [500]
    delays = {(r.sim_time, r.source): r.delay for r in sync.source_delays(steps, "run", 3, master="sim").collect()}
    assert delays[(100, "net")] == 0 and delays[(100, "sim")] == 304
    assert [r.sim_time for r in sync.missing_steps(steps.where("source = 'roads'").select("run", "sim_time"), "run", 100, 1).collect()] == []


def test_sync_state_survives_batches(spark, tmp_path):
    """One file per batch: steps complete across batches, late sources included."""
    source = tmp_path / "steps"
    for i, part in enumerate([[(0, "a", 1), (100, "a", 101)], [(0, "b", 2), (200, "a", 201)], [(100, "b", 95)], [(200, "b", 202), (100, "b", 300)]]):
        df = spark.createDataFrame([(7, *r) for r in part], "run long, sim_time long, source string, system_time long")
        df.coalesce(1).write.mode("append").parquet(str(source))
    schema = "run long, sim_time long, source string, system_time long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = sorted((r.sim_time, r.lag, r.synced) for r in tail.replay(sync.sync_check_stream(stream, "run", 2), wall_clock=True).collect())
    assert got == [(0, 93, True), (100, 100, True)]


def test_a_wrong_time_stamp_gives_up_nothing(spark, tmp_path):
    source = tmp_path / "steps"
    parts = [[(0, "a", 1), (10**12, "a", 5)], [(0, "b", 2), (100, "a", 101)], [(100, "b", 103), (200, "a", 201)],
             [(500, "a", 501), (500, "b", 502)], [(600, "a", 601), (600, "b", 602), (200, "b", 203)]]
    for part in parts:
        df = spark.createDataFrame([(7, *r) for r in part], "run long, sim_time long, source string, system_time long")
        df.coalesce(1).write.mode("append").parquet(str(source))
    schema = "run long, sim_time long, source string, system_time long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = sorted((r.sim_time, r.synced, r.incomplete) for r in tail.replay(sync.sync_check_stream(stream, "run", 2, late=250), wall_clock=True).collect())
    # 200 never met its partner in time and 100 no complete follower; the far step was given up alone
    assert got == [(0, True, False), (100, None, True), (200, None, True), (500, True, False), (10**12, None, True)]


def test_rate_alarm_and_first_reports(spark, tmp_path):
    rows = [(1, s, "a") for s in range(0, 30) if not 10 <= s < 14] * 2
    df = spark.createDataFrame(rows, "run long, s long, source string").withColumn("at", F.timestamp_seconds(F.col("s") + 3600)).withColumn("sim_time", F.col("s"))
    df.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows")
    first = tail.replay(tail.first_reports(stream, "run", "at", "1 hour"))
    assert first.count() == 26
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows")
    alarms = tail.replay(tail.rate_alarm(stream, "run", "at", "5 seconds", "1 second", "1 second", 4))
    quiet = sorted(r["from"].second for r in alarms.where("alarm").collect() if 3600 <= r["from"].timestamp() < 3625)
    assert quiet == [9, 10] and max(r.to.second for r in alarms.collect()) <= 28


def test_session_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, s, v) for s, v in ((0, 4), (1, 4), (2, 0), (20, 4))], "run long, s long, state long").withColumn("at", F.timestamp_seconds(F.col("s") + 3600))
    df.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows")
    out = tail.replay(tail.state_sessions(stream, "run", "at", F.col("state") == 4, "5 seconds", "1 second"))
    assert sorted((r["from"].second, r.n) for r in out.collect()) == [(0, 2)]         # the last one is still open


def test_two_second_batches_fill_gaps(spark, tmp_path):
    df = spark.createDataFrame([(1, s) for s in (0, 100, 300, 400, 700, 900)], "run long, sim_time long")
    df.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows")
    running = tail.every_two_seconds(stream, lambda rows: sync.missing_steps(rows, "run", 100, 1), f"{tmp_path}/out", f"{tmp_path}/progress")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert sorted(r.sim_time for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [200, 500]


def _replayed(spark, folder, base):
    return sorted((r.file.rsplit("/", 1)[-1], r.value) for r in tail.replay(tail.tail_lines(spark, str(folder)), base=str(base)).collect())


def test_tail_follows_appended_rotated_and_truncated_files(spark, tmp_path):
    logs, base = tmp_path / "logs", tmp_path / "replay"
    logs.mkdir()
    (logs / "a.log").write_text("a1\na2\nunfin")
    (logs / "b.log").write_text("b1\r\n")
    (logs / "empty.log").write_text("")
    assert _replayed(spark, logs, base) == [("a.log", "a1"), ("a.log", "a2"), ("b.log", "b1")]
    assert len(_replayed(spark, logs, base)) == 3                                   # nothing new
    with (logs / "a.log").open("a") as f:
        f.write("ished\na4\n")
    (logs / "b.log").rename(logs / "b.log.1")                                       # rotated, and both go on
    with (logs / "b.log.1").open("a") as f:
        f.write("b2\n")
    (logs / "b.log").write_text("new b1\n")
    second = _replayed(spark, logs, base)
    assert second == [("a.log", x) for x in ("a1", "a2", "a4", "unfinished")] + [("b.log", "b1"), ("b.log", "new b1"), ("b.log.1", "b2")]
    (logs / "a.log").write_text("a1\n")                                             # cut off: read again from its start
    (logs / "b.log").unlink()
    assert sorted(set(_replayed(spark, logs, base)) - set(second)) == [] and _replayed(spark, logs, base).count(("a.log", "a1")) == 2


def test_splits_of_a_file_lose_no_line(tmp_path):
    from roadlog.streaming.appended import AppendedReader, read_before

    text = "".join(f"{'x' * (k % 13)}{k}\n" for k in range(400))
    (tmp_path / "a.log").write_text(text)
    for split in (1, 7, 64, 10_000):
        reader = AppendedReader({"path": tmp_path.as_uri(), "splitBytes": str(split)})
        got = [v for part in reader.partitions({}, reader.latestOffset()) for batch in reader.read(part) for v in batch.column(2).to_pylist()]
        assert got == text.split("\n")[:-1]
    same = {"first": 1, "end": 5}
    assert read_before({"a": same}, {"a": {"first": 1, "end": 9}}) == {"a": 5}
    assert read_before({"a": same}, {"a": {"first": 2, "end": 9}}) == {"a": 0}
    assert read_before({"a": same}, {"a.1": {"first": 1, "end": 9}, "a": {"first": 2, "end": 3}}) == {"a.1": 5, "a": 0}


def test_lines_that_are_gone(tmp_path):
    import pytest
    from roadlog.streaming.appended import AppendedReader

    (tmp_path / "a.log").write_text("one\ntwo\n")
    for strict in ("true", "false"):
        reader = AppendedReader({"path": tmp_path.as_uri(), "failOnDataLoss": strict})
        (part,) = reader.partitions({}, {str(tmp_path / "a.log"): {"first": 5, "end": 8}})
        if strict == "true":
            with pytest.raises(OSError):
                list(reader.read(part))
        else:
            assert list(reader.read(part)) == []


def test_appending_again_leaves_one_copy(spark, tmp_path):
    from roadlog.sources import sinks

    rows = spark.createDataFrame([("a.log", k, f"line {k}") for k in range(50)], "file string, t long, value string")
    sinks.append_lines(rows.where("t < 20"), str(tmp_path), "file", ["t"], "value")
    with (tmp_path / "a.log").open("a") as f:
        f.write("half a line of a try that was lost")
    size = len("".join(f"line {k}\n" for k in range(20)))
    from pyarrow import fs

    with sinks._reopened(fs.LocalFileSystem(), str(tmp_path / "a.log"), size) as out:
        out.write(b"line 20\n")
    assert (tmp_path / "a.log").read_text() == "".join(f"line {k}\n" for k in range(21))


def test_step_state_stays_small(spark, tmp_path):
    """Ten thousand steps, one source stops half way: open steps stay within `late` of the newest."""
    source = tmp_path / "steps"
    rows = spark.range(10_000).select(F.lit(7).cast("long").alias("run"), (F.col("id") * 100).alias("sim_time"), F.explode(F.array(*[F.lit(x) for x in "abc"])).alias("source"),
                                      (F.col("id") * 100 + 5).alias("system_time")).where("source <> 'c' OR sim_time < 500000")
    for part in range(4):
        rows.where((F.col("sim_time") >= part * 250_000) & (F.col("sim_time") < (part + 1) * 250_000)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    judged = sync.sync_check_stream(stream, "run", 3, late=5_000)
    with tail._setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "false"):
        query = judged.writeStream.format("memory").queryName("steps_judged").option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 4 and max(sizes) <= 200
    found = spark.table("steps_judged").groupBy("incomplete").count().collect()
    assert {r.incomplete: r["count"] for r in found} == {False: 4999, True: 4950}


def test_silent_entity_is_given_up(spark, tmp_path):
    import time

    source = tmp_path / "steps"
    schema = "run long, sim_time long, source string, system_time long"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    write([(7, 0, "a", 1), (7, 0, "b", 2), (7, 100, "a", 101), (8, 0, "a", 5)])
    judged = sync.sync_check_stream(spark.readStream.schema(schema).parquet(str(source)), "run", 2, silence_ms=1_000)
    first = tail.replay(judged, base=str(tmp_path / "replay"), wall_clock=True)
    assert first.count() == 0
    time.sleep(1.5)
    write([(9, 0, "a", 1)])
    judged = sync.sync_check_stream(spark.readStream.schema(schema).parquet(str(source)), "run", 2, silence_ms=1_000)
    second = tail.replay(judged, base=str(tmp_path / "replay"), wall_clock=True)
    assert sorted((r.run, r.sim_time, r.incomplete) for r in second.collect()) == [(7, 0, True), (7, 100, True), (8, 0, True)]
