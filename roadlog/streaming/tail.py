"""Live forms: log tails, rate alarms, state sessions, and running them once over what is there."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import names
from ..session import shared_dir, written
from ..sources.logs import step_lines
from ..sources.sinks import uri
from .appended import AppendedLines


def tail_lines(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Lines of the files in a folder as they come, those appended to known files too: file, at (byte) and value."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").options(path=uri(folder), pattern=pattern).load()


def tail_steps(spark: SparkSession, folder: str, component: Column, by: list[Column], pattern: str = "*") -> DataFrame:
    """Step lines of a folder of tool logs as sim_time, source and system_time."""
    lines = tail_lines(spark, folder, pattern).select(*by, component.alias("source"), "value")
    return step_lines(lines, [c for c in lines.columns if c != "value"], "value")


def tail_table(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A table's parquet file (or folder) as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*").parquet(folder)


def tail_topic(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Records of live topics: created_ms and value, as the dump parser gives them."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).load()
    return rows.select("topic", F.unix_millis("timestamp").alias("created_ms"), F.col("value").cast("string").alias("record"))


def first_reports(steps: DataFrame, by, ts: str, late: str) -> DataFrame:
    """One report per entity, step and source; reports later than `late` behind the newest are dropped."""
    return steps.withWatermark(ts, late).dropDuplicatesWithinWatermark([*names(by), "sim_time", "source"])


def rate_alarm(rows: DataFrame, by, ts: str, window: str, slide: str, late: str, least: int) -> DataFrame:
    """Message counts of sliding windows with an alarm flag where they are below a limit."""
    counted = rows.withWatermark(ts, late).groupBy(*names(by), F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*names(by), F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n", (F.col("n") < least).alias("alarm"))


def state_sessions(rows: DataFrame, by, ts: str, holds: Column, gap: str, late: str) -> DataFrame:
    """Sessions of rows in a state, closed by a pause."""
    active = rows.where(holds).withWatermark(ts, late)
    grouped = active.groupBy(*names(by), F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*names(by), F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def replay(stream: DataFrame, mode: str = "append", base: str | None = None, wall_clock: bool = False) -> DataFrame:
    """Run a stream over everything there is and read back all it has written so far.

    Output and progress go to `base`, a new folder of the shared folder where none is given, so a lost executor or driver
    resumes from the last finished batch, and a later call with the same folder goes on behind it. With `wall_clock`, for
    streams with timers of wall-clock time, there are no batches without new rows, as those would never end: such timers fire
    with the next rows.
    """
    spark = stream.sparkSession
    with _setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", str(not wall_clock).lower()):
        return _replayed(stream, mode, base)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting for what is started inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _replayed(stream: DataFrame, mode: str, base: str | None) -> DataFrame:
    spark = stream.sparkSession
    base = base or written(spark, f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}")
    if mode == "append":
        started = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/progress").trigger(
            availableNow=True).start(f"{base}/rows")
    else:
        write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/rows")
        started = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(
            availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def every_two_seconds(stream: DataFrame, step, target: str, progress: str):
    """Start a stream that hands each micro-batch to `step(rows)` and appends the result to a folder."""

    def write(rows: DataFrame, batch: int) -> None:
        step(rows).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return stream.writeStream.option("checkpointLocation", progress).trigger(processingTime="2 seconds").foreachBatch(write).start()
