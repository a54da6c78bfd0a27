"""Writers. Each replaces its target, so a repeated run leaves one copy."""

from __future__ import annotations

import pathlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import names


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_topics(messages: DataFrame, path: str) -> None:
    """One folder per topic; slashes in topic names become underscores."""
    named = messages.withColumn("topic", F.regexp_replace(F.regexp_replace("topic", "^/", ""), "/", "_"))
    named.write.mode("overwrite").partitionBy("topic").parquet(path)


def write_sheets(metrics: DataFrame, path: str) -> None:
    """One folder per metric id."""
    metrics.write.mode("overwrite").partitionBy("metric_id").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], batch: int = 10_000) -> None:
    """Replace a warehouse table in batches."""
    df.write.mode("overwrite").option("truncate", True).option("batchsize", batch).jdbc(url, table, properties=properties)


def write_messages(messages: DataFrame, path: str, by, t: str) -> None:
    """The message log as the scans want it: a folder per topic, sorted by entity and time inside."""
    spread = messages.repartitionByRange("topic", *names(by), t).sortWithinPartitions("topic", *names(by), t)
    spread.write.mode("overwrite").partitionBy("topic").parquet(path)


def save_bucketed(messages: DataFrame, table: str, by, t: str, buckets: int) -> None:
    """The message log as a table bucketed by entity and sorted by time.

    Windows, as-of joins and aggregates per entity then need no shuffle, so a catalogue of metrics
    shuffles the recordings once, when they are stored.
    """
    keys = names(by)
    messages.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, t).saveAsTable(table)


def uri(folder: str) -> str:
    """A folder as an address, a plain path as one of files that every machine sees."""
    return folder if "://" in folder or folder.startswith("file:") else pathlib.Path(folder).absolute().as_uri()


def append_lines(rows: DataFrame, folder: str, file: str, order: list[str], text: str) -> dict[str, int]:
    """Append lines to the text files that the column `file` names, in order; returns the sizes of those files.

    A file's lines come through one task, which writes them as they come; another try of the task begins again where the
    file ended before. The folder has to allow appending.
    """
    address = uri(folder)
    system, path = fs.FileSystem.from_uri(address)
    system.create_dir(path, recursive=True)
    before = {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(path)) if f.is_file}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(address)
        name, out, sizes = None, None, {}
        for batch in batches:
            for here, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if here != name:
                    if out:
                        sizes[name] = out.tell()
                        out.close()
                    name, out = here, _reopened(system, f"{path}/{here}", before.get(here, 0))
                out.write(((line or "") + "\n").encode())
        if out:
            sizes[name] = out.tell()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(sizes), pa.string()), pa.array(list(sizes.values()), pa.int64())], ["file", "size"])

    sorted_ = rows.repartition(file).sortWithinPartitions(file, *order).select(file, text)
    return {r["file"]: r["size"] for r in sorted_.mapInArrow(write, "file string, size long").collect()}


def _reopened(system: fs.FileSystem, path: str, size: int):
    """The file to go on writing behind its first `size` bytes."""
    if size == 0:
        return system.open_output_stream(path)
    if system.get_file_info(path).size > size:              # what an earlier try of the task has left
        with system.open_input_file(path) as file:
            kept = file.read(size)
        with system.open_output_stream(path) as out:
            out.write(kept)
    return system.open_append_stream(path)
