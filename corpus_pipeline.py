"""A training corpus from the table of documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All but
the last return the columns of docs. Stages that shorten texts bring `n_chars` up to date where that column exists.

Cases: documents with a null text pass through every stage (no words, one empty line, nothing to find) and have size 0 in
the mix; they are near copies of each other, so one of them stays; an empty table stays empty; columns beyond those of documents
are kept up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlog.llm import decontaminate, lines, mixing, simhash, toxicity
from roadlog.llm.common import cut, load


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns named, the number of characters as the text now has it."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two language models take for ordinary."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.ordinary(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them."""
    return _measured(lines.remove(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are similar by 0.8 or more."""
    return simhash.distinct(docs, size=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of ten words or more that a test item has are cut out; documents that are mostly such spans go."""
    cleaned = decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))
    return _measured(cleaned, docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, target of the source, copies the mix takes, and the words taken; documents not taken have 0."""
    rows = cut(mixing.sized(docs))
    sources = cut(mixing.targets(mixing.cyclic_weights(mixing.source_sizes(rows))))
    mixed = mixing.mix(rows, sources)
    return mixed.select("doc_id", "source", "size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_shared_lines), ("near_dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("mixing", mix_sources)]

# learned scores and near-copy classes cannot be said in SQL; tests compare every stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
