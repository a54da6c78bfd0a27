"""Session settings and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str, master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the library expects; `master` is for local runs only."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the one the cluster names, or the one already set.

    Only a local session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="roadlog-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


_WRITTEN: dict[str, list[str]] = {}


def written(spark: SparkSession, path: str) -> str:
    """Note a folder as one that `clear` may remove."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove the tables that this session has cut so far; for when no DataFrame made from them is used any more."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    return len(paths)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table to the shared folder and read on from there.

    Later steps do not redo the work, a lost executor loses none of it, and the optimizer knows the
    table's size.
    """
    spark = df.sparkSession
    path = written(spark, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


AT_ONCE = 8


def together(spark: SparkSession, calls: list[Callable]) -> list:
    """The results of calls that do not need one another; their plans are made and their jobs run side by side."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        begun = [pool.submit(copy_context().run, inheritable_thread_target(spark)(call)) for call in calls]
        return [one.result() for one in begun]


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Rows of very many computed columns: generated methods stay below the size that the JVM still compiles.

    Beyond 8000 bytes the JVM interprets a method, which is slower than the operator without generated stages.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)
