"""Exact deduplication through a persistent index of text digests, with DataFrame functions only.

The index is a table of one row per distinct text: its SHA-256, the row that stays and the batch that brought it,
bucketed and sorted by the digest. A batch is aggregated to one row per digest, met with the index by a sort-merge
anti-join, and what the index does not know is appended. The index is never shuffled: the batch is dealt into
its buckets.

Counts and the choice of the row that stays come from an aggregate that is combined before its shuffle, so a text that
a third of all rows hold sends one row per task. The way back from digests to rows goes apart for such texts: a text
that more than one row in `HOT_SHARE` holds is one of at most `HOT_SHARE` texts, whose decisions are broadcast; all
others are sort-merge joined.

Texts are equal when they are after all ASCII white space is deleted. Of equal texts of a batch the row with the most code
points stays, then the one with the smallest id; an indexed text drops all rows of later batches.

Cases: a null text counts as empty, and all empty texts are equal; a null id sorts after all others; of rows that agree in
id and length one stays, by a hash of the text as it is; of rows that agree in everything one stays, any; texts of every
length are hashed whole; an empty batch adds nothing and gives no rows; other columns of the documents are carried in one
struct, so their names cannot clash; a batch that is given again, after a driver was lost, appends nothing and decides
alike. Ids are whole numbers.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlog.llm.common import cut, pieces

SPACE = " \t\n\x0b\x0c\r"            # fixed value: ASCII white space
BUCKET_ROWS = 200_000
LEAST_BUCKETS = 8
HOT_SHARE = 1024


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    filled = F.coalesce(text.cast("string"), F.lit(""))
    return functools.reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), SPACE, filled)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, chars, mark, digest and row of each document; with `carry` all its columns as the struct `doc`.

    `row` tells apart rows that agree in all else; it holds only in the table that this is written to.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("chars"), F.xxhash64(text).alias("mark"),
                       F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"),
                       F.monotonically_increasing_id().alias("row"), *whole)


def _by_digest(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays and how many rows there are."""
    order = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark", "row")
    return rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))


class DigestIndex:
    """The index in a folder that all executors share. `buckets` is fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/texts'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: int) -> DigestIndex:
        """A new index for about `rows` distinct texts; more only make its buckets larger."""
        buckets = pieces(rows, BUCKET_ROWS, LEAST_BUCKETS)
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.json(f"{path}/layout")
        return cls(spark, path, buckets)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DigestIndex:
        """The index that an earlier session made."""
        return cls(spark, path, spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"])

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def absorb(self, rows: DataFrame, batch: str) -> DataFrame:
        """Decide about the rows of a batch and append its new texts.

        `rows` is a written table as of `digested`. Returns its columns with keep_id, the id of the row that stays,
        group_size, the batch's rows of that text, and kept.
        """
        texts = cut(_by_digest(rows).select("digest", "best.doc_id", "best.row", "group_size"))
        dealt = texts.repartition(self.buckets, "digest")
        earlier = self.rows()
        if not earlier.filter(F.col("batch") == batch).head(1):
            fresh = dealt.join(earlier.hint("merge"), "digest", "left_anti")
            fresh.select("digest", F.col("doc_id").alias("keep_id"), F.lit(batch).alias("batch")).write.insertInto(self.table)
        known = self.rows().filter(F.col("batch") != batch).select("digest", "keep_id", F.lit(True).alias("known"))
        decided = dealt.join(known.hint("merge"), "digest", "left").select(
            "digest", F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
            F.when(F.col("known").isNull(), F.col("row")).alias("keep_row"), "group_size")
        return _returned(rows, cut(decided))


def _returned(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows with the decision on their text."""
    hot = F.broadcast(decided.filter(F.col("group_size") > rows.count() / HOT_SHARE))      # at most HOT_SHARE rows
    often = rows.join(hot, "digest")
    rest = rows.join(hot.select("digest"), "digest", "left_anti").join(decided, "digest")
    kept = F.coalesce(F.col("keep_row") == F.col("row"), F.lit(False))
    return often.unionByName(rest).withColumn("kept", kept).drop("keep_row")


def distinct(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of a batch that stay, with all their columns; their texts are in the index afterwards."""
    return index.absorb(cut(digested(docs, id_col, text_col, carry=True)), batch).filter("kept").select("doc.*")
