"""Registered queries: a Spark function over a folder of tables and, where there is one, equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import planned, row_limit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

H = 3_600_000_000       # an hour in the microseconds of the event clock
DAY = 24 * H

# moves values off the exact halves that two engines may round to different sides
SHIFT = 1e-9

# the events table as a message log
EV = """ev AS (SELECT user_id AS run_id, epoch_us(ts) AS t, event_id AS seq, event_type AS topic, value,
 CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(stamp: str) -> Column:
    """Epoch microseconds of a time without zone, whatever the session's zone is."""
    return F.unix_micros(F.to_utc_timestamp(F.col(stamp).cast("timestamp"), F.current_timezone()))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a message log: run_id, t, seq, topic, value, k."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), micros("ts").alias("t"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("topic"), "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"))


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "f":
        return (F.round(c.cast("double") + F.lit(SHIFT), 6) + F.lit(0.0)).alias(name)
    return c.cast({"b": "boolean", "s": "string"}[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "f":
        return f"ROUND(CAST({name} AS DOUBLE) + {SHIFT}, 6) + 0.0 AS {name}"
    return f"CAST({name} AS {'BOOLEAN' if kind == 'b' else 'VARCHAR'}) AS {name}"


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `columns` is `name:kind ...` with kinds i, f (rounded), b and s."""
    kinds = [c.split(":") for c in columns.split()]

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the message log is measured once, when a step of the query needs to know how dense it is
            with planned(lambda: messages(spark, sf_dir), "run_id", "t"):
                return build(spark, sf_dir).select(*[_spark_column(n, k) for n, k in kinds])

        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            picked = ", ".join(_sql_column(n, k) for n, k in kinds)
            ORACLES[name] = f"SELECT {picked} FROM ({body}) AS q"
        return build

    return register


def cut_twin(name: str, rows: int) -> None:
    """Register a query once more, with so small a row budget that its recordings are cut: the same rows are due."""
    whole = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with row_limit(rows):
            return whole(spark, sf_dir)

    QUERIES[f"{name}_cut"] = run
    if name in ORACLES:
        ORACLES[f"{name}_cut"] = ORACLES[name]
