"""Tables and files: topic scans, CSV variants, JSON documents, file selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(messages: DataFrame, topics: list[str], start=None, end=None, t: str = "t") -> DataFrame:
    """Messages of the topics, bounds included; topic and time reach the file scan as filters."""
    out = messages.where(F.col("topic").isin(topics))
    if start is not None:
        out = out.where(F.col(t) >= F.lit(start))
    if end is not None:
        out = out.where(F.col(t) <= F.lit(end))
    return out


def topic_counts(messages: DataFrame, by: list[str]) -> DataFrame:
    """Message count per topic."""
    return messages.groupBy(*by, "topic").agg(F.count(F.lit(1)).alias("n"))


def read_csv(spark: SparkSession, path, schema: str, *, header: bool = True, strict: bool = False) -> DataFrame:
    """CSV with a declared schema; the schema's names replace those of a header line.

    Headerless files take the schema's names in order. strict checks the header against the schema and
    fails on malformed rows.
    """
    reader = spark.read.schema(schema).option("header", header)
    if strict:
        reader = reader.option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(path)


def split_spaces(lines: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """Lines of values separated by any white space."""
    parts = F.split(F.trim(text), r"\s+")
    return lines.select(*[c for c in lines.columns if c != text],
                        *[F.get(parts, F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(fields.items())])


def read_json_document(spark: SparkSession, path, schema: str) -> DataFrame:
    """A JSON document (one value over many lines) per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def merged(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet tables whose columns grew over time, read with the union of their columns."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def select_files(files: DataFrame, path: str, ids: list[str], vehicle: str | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Files whose path contains every id (and the vehicle), without the excluded ones."""
    condition: Column = F.lit(True)
    for part in [*ids, *([vehicle] if vehicle else [])]:
        condition = condition & F.col(path).contains(part)
    chosen = files.where(condition)
    return chosen if exclude is None else chosen.join(exclude.select(path).distinct(), path, "left_anti")


def newest(files: DataFrame, by: list[str], path: str, modified: str) -> DataFrame:
    """The newest file per group."""
    return files.groupBy(*by).agg(F.max_by(path, F.struct(modified, path)).alias(path), F.max(modified).alias(modified))


def file_listing(spark: SparkSession, path, pattern: str) -> DataFrame:
    """Path, modification time and length of matching files, without reading their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select(
        "path", "modificationTime", "length")
