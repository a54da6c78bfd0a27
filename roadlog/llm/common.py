"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadlog import session

WORD = r"[^\x20\x09-\x0D]+"          # fixed value: words are what ASCII white space parts

cut = session.cut


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text of each document, so that other columns cannot clash with results."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pieces(rows: int, per_piece: int, least: int = 1) -> int:
    """How many pieces of about `per_piece` rows the rows make: grows in proportion, at least `least`."""
    return max(least, -(-rows // per_piece))


GROUP_CHARS = 4_000_000


def groups_of(docs: DataFrame, text_col: str, group_rows: int, shard_rows: int) -> tuple[int, int]:
    """How many groups and shards the documents make.

    A group has about `group_rows` documents, fewer where texts are long: no more than about four million characters.
    Shards grow with the number of documents and with the characters alike.
    """
    n, chars = docs.agg(F.count(F.lit(1)), F.sum(F.length(F.col(text_col).cast("string")).cast("long"))).first()
    return (max(pieces(n, group_rows), pieces(chars or 0, GROUP_CHARS)),
            max(pieces(n, shard_rows), pieces(chars or 0, GROUP_CHARS * shard_rows // group_rows)))


def smallest(rows: DataFrame, key: str, ties: Sequence[str], size: int) -> DataFrame:
    """The `size` rows with the smallest 64-bit hash `key`. `rows` is a written table, as it is counted first.

    Rows whose hash cannot be among the smallest are filtered out before the sort, so each task sends
    only its share of the `size` rows.
    """
    n = rows.count()
    share = min(1.0, 1.2 * size / max(n, 1) + 100 / max(n, 1))
    near = rows if share == 1.0 else rows.filter(F.col(key) < int(-(1 << 63) + share * (1 << 64)))
    return near.orderBy(key, *ties).limit(size)


def map_texts(rows: DataFrame, work: Callable[[list[str]], dict[str, Sequence]], columns: Sequence[T.StructField]) -> DataFrame:
    """Run `work` over batches of the text column of (doc_id, text); a null text is empty.

    `work` gets the texts of one Arrow batch and returns a sequence per output column. The output is
    doc_id and these columns.
    """
    out = T.StructType([rows.schema["doc_id"], *columns])
    names = [f.name for f in columns]
    kinds = [arrow_type(f.dataType) for f in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                got = work([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(got[n], k) for n, k in zip(names, kinds)]], ["doc_id", *names])

    return rows.select("doc_id", "text").mapInArrow(run, out)


def sliced(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that Python objects exist for a few hundred rows at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(),
              T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return simple[kind]


def field(name: str, kind: str) -> T.StructField:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
             "boolean": T.BooleanType(), "binary": T.BinaryType()}
    return T.StructField(name, T.ArrayType(kinds[kind[:-2]]) if kind.endswith("[]") else kinds[kind])


def rewritten(docs: DataFrame, text_col: str, change: Callable[[str], str]) -> DataFrame:
    """All columns of the documents as they are, the text through `change`; a null text stays null."""
    at = docs.schema.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                texts = [None if x is None else change(x) for x in part.column(at).to_pylist()]
                columns = [*part.columns[:at], pa.array(texts, part.schema.field(at).type), *part.columns[at + 1:]]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """The text with each span (start, end, mask) replaced; of spans that overlap, one mask stands for all."""
    out, at = [], 0
    for start, end, mask in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
