"""Typing, renaming, flattening and decoding of message tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import names


@dataclass(frozen=True)
class Mapping:
    """One column of a mapping list: source name and type to target name and type."""

    source: str
    source_type: str
    target: str
    target_type: str


def _typed(column: Column, kind: T.DataType, target: str) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) and target == "string":
        return F.to_json(column)
    return column.try_cast(target)


def apply_mapping(df: DataFrame, mappings: list[Mapping | tuple]) -> DataFrame:
    """Select, rename and cast by a mapping list; other columns are dropped, arrays become JSON text."""
    wanted = [m if isinstance(m, Mapping) else Mapping(*m) for m in mappings]
    return df.select(*[_typed(F.col(m.source), df.schema[m.source].dataType, m.target_type).alias(m.target) for m in wanted])


def resolve_choice(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Split a text column of mixed types into one column per type: the first type that fits is filled."""
    out = []
    for name in df.columns:
        if name not in columns:
            out.append(F.col(name))
            continue
        taken = F.lit(False)
        for kind in columns[name]:
            value = F.col(name) if kind == "string" else F.col(name).try_cast(kind)
            fits = value.isNotNull() & ~taken
            out.append(F.when(fits, value).alias(f"{name}_{kind}"))
            taken = taken | value.isNotNull()
    return df.select(*out)


def drop_null_fields(df: DataFrame, check_values: bool = False) -> DataFrame:
    """Drop columns whose type is null, and on request those without any value (one aggregate row)."""
    kept = [f.name for f in df.schema if not isinstance(f.dataType, T.NullType)]
    if check_values and kept:
        seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in kept]).first()
        kept = [c for c in kept if seen[c]]
    return df.select(*kept)


def copy_tables(spark, steps: list[tuple[str, str, list[Mapping]]], read, write, at_once: int = 8) -> list[tuple[str, str]]:
    """Run one read, map, resolve and write step per table, several `at_once`; a failing table does not stop the others.

    Returns (table, "ok" or the error text) in the order of the steps. A target named twice is written once. Each step has a
    scheduler pool of its own, so with fair scheduling a long step does not hold up the short ones.
    """
    first: dict[str, tuple] = {}
    for source, target, mappings in steps:
        first.setdefault(target, (source, mappings))

    @inheritable_thread_target(spark)
    def run(target: str) -> tuple[str, str]:
        source, mappings = first[target]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"copy-{target}")
        try:
            write(drop_null_fields(apply_mapping(read(spark, source), mappings)), target)
            return target, "ok"
        except Exception as error:  # noqa: BLE001 - the status table carries the reason
            return target, str(error).splitlines()[0]
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, first))


def flatten_pairs(df: DataFrame, keys: list[str], text: str, fields: list[str], line: str = "\n", pair: str = ":") -> DataFrame:
    """`name: value` lines of a printed message to one column per field.

    The field list is fixed beforehand, so a nested name without value cannot shift the others, and
    only the first separator of a line splits it.
    """
    lines = F.split(F.col(text), line)
    out = []
    named = lambda field: lambda line: F.trim(F.split(line, pair, 2)[0]) == F.lit(field)
    for field in fields:
        hit = F.filter(lines, named(field))
        value = F.trim(F.get(F.split(F.get(hit, F.lit(0)), pair, 2), F.lit(1)))
        out.append(F.when(value != "", value).alias(field))
    return df.select(*keys, *out)


def field_dictionary(schema: T.StructType, topic: str) -> list[tuple[str, str, str]]:
    """(topic, dotted field, type) of every leaf of a schema."""
    rows = []

    def walk(prefix: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{prefix}.{f.name}" if prefix else f.name, f.dataType)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            walk(f"{prefix}[]", kind.elementType)
        else:
            rows.append((topic, prefix, kind.simpleString()))

    walk("", schema)
    return rows


def payload_dictionary(df: DataFrame, topic: str, payload: str, t: str, tie=(), only: list[str] | None = None) -> DataFrame:
    """Topic, field and type of the first JSON message of every topic (or of the listed topics)."""
    rows = df if only is None else df.where(F.col(topic).isin(only))
    first = rows.groupBy(topic).agg(F.min_by(payload, F.struct(t, *names(tie))).alias("__p"))
    fields = first.select(topic, F.explode(F.from_json("__p", "map<string, string>")).alias("field", "__v"))
    value = F.col("__v")
    kind = (F.when(value.isNull(), "null").when(value.try_cast("long").isNotNull(), "long")
            .when(value.try_cast("double").isNotNull(), "double").when(value.isin("true", "false"), "boolean")
            .otherwise("string"))
    return fields.select(topic, "field", kind.alias("type"))


def explode_objects(df: DataFrame, array: str, keep: list[str], position: str | None = None) -> DataFrame:
    """One row per element of an array of structs, with its fields as columns."""
    if position:
        spread = df.select(*keep, F.posexplode(array).alias(position, "__o"))
        return spread.select(*keep, position, "__o.*")
    return df.select(*keep, F.inline(array))


def object_with_id(array: str, field: str, wanted: Column) -> Column:
    """The first element of an array of structs whose field equals a value."""
    return F.get(F.filter(array, lambda o: o[field] == wanted), F.lit(0))


def align_columns(tables: list[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are null."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def latest(df: DataFrame, by, order: list[Column]) -> DataFrame:
    """The last row of every group in the given order."""
    rest = [c for c in df.columns if c not in names(by)]
    return df.groupBy(*names(by)).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__l")).select(*names(by), "__l.*")


def pivot_first(df: DataFrame, by, column: str, values: list, t: str) -> DataFrame:
    """First time of every value of a column as one column per value."""
    return df.groupBy(*names(by)).pivot(column, values).agg(F.min(t))


def rank_in(by, *order) -> Column:
    return F.row_number().over(Window.partitionBy(*names(by)).orderBy(*order))
