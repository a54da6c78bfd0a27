"""Aggregates: summary statistics, exact quantiles that survive a hot group, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import Ordered, as_column, names, null_safe_join, row_budget


def quantiles(df: DataFrame, by, value, points: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: by, n, q (array in the order of `points`).

    Small groups use the built-in aggregate. When a group is over the row budget, its values are
    counted per distinct value, ranked in value order with the same cutting as event time, and only
    the rows at the wanted ranks are kept.
    """
    keys = names(by)
    data = df.select(*keys, as_column(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    built_in = lambda d: d.groupBy(*keys).agg(
        F.count("__v").alias("n"), F.percentile("__v", F.array(*[F.lit(float(p)) for p in points])).alias("q"))
    largest = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if largest is None or largest <= row_budget(data):
        return built_in(data)
    counted = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__c"))
    scope = keys or ["__all"]
    counted = counted if keys else counted.withColumn("__all", F.lit(0))
    o = Ordered.of(counted, scope, "__v").running(__to=("sum", "__c"))
    totals = counted.groupBy(*scope).agg(F.sum("__c").alias("n"))
    ranked = null_safe_join(o.df, totals, scope)
    picks = []
    for i, p in enumerate(points):
        place = F.lit(float(p)) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            hit = (F.col("__to") > rank) & (F.col("__to") - F.col("__c") <= rank)
            picks.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}{i}"))
    picked = ranked.groupBy(*scope).agg(F.max("n").alias("n"), *picks)
    values = []
    for i, p in enumerate(points):
        place = F.lit(float(p)) * (F.col("n") - 1)
        values.append(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (place - F.floor(place)))
    return picked.select(*keys, "n", F.array(*values).alias("q"))


def group_stats(df: DataFrame, by, value) -> DataFrame:
    """Mean, min, median, max, sample standard deviation and count per group."""
    keys = names(by)
    data = df.select(*keys, as_column(value).cast("double").alias("__v"))
    basic = data.groupBy(*keys).agg(
        F.avg("__v").alias("mean"), F.min("__v").alias("min"), F.max("__v").alias("max"),
        F.stddev_samp("__v").alias("std"), F.count("__v").alias("count"))
    middle = quantiles(data, keys, "__v", [0.5]).select(*keys, F.col("q")[0].alias("median"))
    return null_safe_join(basic, middle, keys, "left") if keys else basic.crossJoin(F.broadcast(middle))


def describe(df: DataFrame, by, value) -> DataFrame:
    """count, mean, std, min, quartiles and max of one column per group."""
    keys = names(by)
    data = df.select(*keys, as_column(value).cast("double").alias("__v"))
    basic = data.groupBy(*keys).agg(
        F.count("__v").alias("count"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("std"))
    marks = quantiles(data, keys, "__v", [0.0, 0.25, 0.5, 0.75, 1.0])
    marks = marks.select(*keys, *[F.col("q")[i].alias(c) for i, c in enumerate(["min", "q25", "q50", "q75", "max"])])
    return null_safe_join(basic, marks, keys, "left") if keys else basic.crossJoin(F.broadcast(marks))


def pass_share(df: DataFrame, by, value, limit: float, share: float = 90.0) -> DataFrame:
    """Mean, population deviation and percentage under a limit, passing at `share` percent."""
    v = as_column(value)
    under = F.count_if(v < limit) * 100.0 / F.count(v)
    return df.groupBy(*names(by)).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), under.alias("pct_under")
    ).withColumn("passed", F.col("pct_under") >= share)


def share_of_entities(df: DataFrame, entity, by, value, limit: float) -> DataFrame:
    """Mean of the per-entity means and the percentage of entities whose mean is over a limit."""
    per = df.groupBy(*names(by), *names(entity)).agg(F.avg(as_column(value)).alias("m"))
    return per.groupBy(*names(by)).agg(
        F.count(F.lit(1)).alias("n_entities"), F.avg("m").alias("mean_of_means"),
        (F.count_if(F.col("m") > limit) * 100.0 / F.count(F.lit(1))).alias("pct_over"))


def histogram(df: DataFrame, by, value, width: float) -> DataFrame:
    """Counts per bin of fixed width; bin is the lower edge."""
    lower = F.floor(as_column(value) / F.lit(width)) * F.lit(width)
    return df.groupBy(*names(by), lower.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_bins(df: DataFrame, by, value, bins: int) -> DataFrame:
    """Counts in equal bins between each group's least and greatest value, the last bin closed."""
    keys = names(by)
    v = as_column(value)
    data = df.select(*keys, v.alias("__v"))
    ends = data.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    joined = data.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("c"))
    joined = null_safe_join(joined, ends, keys) if keys else joined.crossJoin(ends)
    place = F.floor(F.try_divide((F.col("__v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    slot = F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0)))
    return joined.groupBy(*keys, slot.cast("long").alias("slot")).agg(F.sum("c").alias("n"))


def weighted_spread(df: DataFrame, by, value, weight) -> DataFrame:
    """Weighted mean and standard deviation with the reliability-weight correction."""
    v, w = as_column(value).cast("double"), as_column(weight).cast("double")
    centre = df.groupBy(*names(by)).agg(
        F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * v).alias("swx"), F.sum(w * v * v).alias("swx2"))
    mean = F.try_divide(F.col("swx"), F.col("sw"))
    spread = F.try_divide(F.col("swx2") - F.col("swx") * mean, F.col("sw") - F.try_divide(F.col("sw2"), F.col("sw")))
    return centre.select(*names(by), mean.alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("sd"))


def class_counts(df: DataFrame, by, **classes: Column) -> DataFrame:
    """Number of rows in each class, in one pass."""
    return df.groupBy(*names(by)).agg(*[F.count_if(c).alias(n) for n, c in classes.items()])


def box_numbers(df: DataFrame, by, value) -> DataFrame:
    """The five numbers of a box plot per group."""
    marks = quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0])
    return marks.select(*names(by), "n", *[F.col("q")[i].alias(c) for i, c in enumerate(["low", "q25", "q50", "q75", "high"])])


def ordered_distinct(df: DataFrame, by, item: str, t: str) -> DataFrame:
    """Distinct items of an entity in order of first appearance, as rows (by, item, t_first, place)."""
    keys = names(by)
    first = df.groupBy(*keys, item).agg(F.min(t).alias("t_first"))
    return Ordered.of(first, by, "t_first", item).number("place").df


def top_per_group(df: DataFrame, by, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every group (row_number <= n is limited before the shuffle)."""
    window = Window.partitionBy(*names(by)).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)
