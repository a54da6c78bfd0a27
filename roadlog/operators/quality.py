"""Guards: dimension lookups, match counts, verdicts when a prerequisite is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, take: list[str]) -> DataFrame:
    """Facts with dimension columns and the number of dimension rows found (1 when all is well)."""
    one = dim.groupBy(dim_key).agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct(*take)).alias("__d"))
    joined = facts.join(one, F.col(fact_key) == F.col(dim_key), "left")
    kept = [c for c in facts.columns if c not in take]
    return joined.select(*kept, *[F.col("__d")[c].alias(c) for c in take], F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def match_counts(pairs: DataFrame, matched: str) -> DataFrame:
    """Number of targets, of matched ones, and whether all are matched."""
    return pairs.agg(F.count(F.lit(1)).alias("n_targets"), F.count(matched).alias("n_matched")).withColumn(
        "complete", F.col("n_targets") == F.col("n_matched"))


def verdict(needed: list[Column], passed: Column) -> Column:
    """passed or failed, or not_evaluated when something needed is null."""
    missing = F.lit(False)
    for column in needed:
        missing = missing | column.isNull()
    return (F.when(missing | passed.isNull(), "not_evaluated").when(passed, "passed").otherwise("failed"))


def bad_share(good: DataFrame, bad: DataFrame, by: list[str]) -> DataFrame:
    """Counts of good and skipped records per group."""
    flagged = good.select(*by, F.lit(0).alias("__bad")).unionByName(bad.select(*by, F.lit(1).alias("__bad")))
    return flagged.groupBy(*by).agg(F.count_if(F.col("__bad") == 0).alias("n_good"), F.count_if(F.col("__bad") == 1).alias("n_skipped"))
