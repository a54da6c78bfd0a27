"""Gap, rate and time-share measures of message streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, as_column, names


def with_gap(df: DataFrame, by, t: str, tie=(), name: str = "gap") -> DataFrame:
    """Time since the previous row of the entity."""
    return Ordered.of(df, by, t, tie).prev(__pt=t).with_columns(**{name: F.col(t) - F.col("__pt")}).df.drop("__pt")


def gap_coverage(df: DataFrame, by, t: str, tie, limit: float) -> DataFrame:
    """Share of time covered by gaps under the limit, and the largest and number of longer gaps."""
    gaps = with_gap(df, by, t, tie)
    short = F.col("gap") < limit
    total = F.sum("gap")
    covered = F.coalesce(F.sum(F.when(short, F.col("gap"))), F.lit(0))
    return gaps.groupBy(*names(by)).agg(
        covered.alias("covered"), total.alias("total"),
        F.try_divide(covered * 100.0, total).alias("pct"),
        F.max("gap").alias("max_gap"), F.count_if(F.col("gap") >= limit).alias("n_long"),
        F.count("gap").alias("n_gaps"),
    )


def time_in_state(df: DataFrame, by, t: str, tie, holds: Column) -> DataFrame:
    """Time for which a condition holds; a gap counts to the condition of the row that ends it."""
    gaps = with_gap(df.withColumn("__on", F.coalesce(holds, F.lit(False))), by, t, tie)
    on = F.coalesce(F.sum(F.when(F.col("__on"), F.col("gap"))), F.lit(0))
    off = F.coalesce(F.sum(F.when(~F.col("__on"), F.col("gap"))), F.lit(0))
    return gaps.groupBy(*names(by)).agg(
        on.alias("t_true"), off.alias("t_false"), F.try_divide(on * 100.0, F.sum("gap")).alias("pct")
    )


def average_frequency(df: DataFrame, by, t: str, unit: float) -> DataFrame:
    """(n - 1) / (last - first) in 1/unit, plus 1/mean and the spread of 1/gap."""
    o = Ordered.of(df, by, t).prev(__pt=t).with_columns(__gap=(F.col(t) - F.col("__pt")) / F.lit(unit))
    inverse = F.try_divide(F.lit(1.0), F.col("__gap"))
    return o.df.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.count(F.lit(1)) - 1.0, (F.max(t) - F.min(t)) / F.lit(unit)).alias("frequency"),
        F.stddev_pop(inverse).alias("frequency_sd"),
    )


def rate_over_next(df: DataFrame, by, t: str, tie, value, horizon: float, unit: float) -> DataFrame:
    """Change per unit from each row to the first row at least `horizon` later (null when none)."""
    from .asof import asof_join

    keys = names(by)
    base = df.withColumn("__at", F.col(t) + F.lit(horizon))
    later = df.select(*keys, F.col(t).alias("__at"), *[F.col(c).alias(f"__{c}") for c in names(tie)],
                      F.col(t).alias("t_next"), as_column(value).alias("value_next"))
    joined = asof_join(base, later, by, "__at", direction="forward", right_tie=[f"__{c}" for c in names(tie)],
                       columns=["t_next", "value_next"])
    change = (F.col("value_next") - as_column(value)) / ((F.col("t_next") - F.col(t)) / F.lit(unit))
    return joined.withColumn("rate", change).drop("__at")


def section_rate(df: DataFrame, by, t: str, tie, value, begins: Column, ends: Column, unit: float) -> DataFrame:
    """Mean rate of change between the first row that begins a section and the first end after it."""
    keys = names(by)
    order = F.struct(t, *names(tie))
    o = Ordered.of(df, by, t, tie).with_columns(__v=as_column(value)).running(
        __t0=("min", F.when(begins, F.col(t))), __seen=("last", F.lit(1))
    )
    first = F.min_by(F.struct(F.col(t).alias("t"), F.col("__v").alias("v")), F.when(begins, order))
    final = F.min_by(F.struct(F.col(t).alias("t"), F.col("__v").alias("v")),
                     F.when(ends & (F.col(t) > F.col("__t0")), order))
    cut = o.df.groupBy(*keys).agg(first.alias("__a"), final.alias("__b"))
    return cut.select(
        *keys, F.col("__a.t").alias("t_begin"), F.col("__b.t").alias("t_end"),
        F.try_divide(F.col("__b.v") - F.col("__a.v"), (F.col("__b.t") - F.col("__a.t")) / F.lit(unit)).alias("rate"),
    )
