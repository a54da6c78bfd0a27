"""State intervals, runs of rows that hold a condition, and samples inside intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, as_column, chunk_width, names


def state_intervals(df: DataFrame, by, t: str, tie, holds: Column, close: str = "next_row") -> DataFrame:
    """Stretches of rows where `holds` is true: by, seq, start, end, n.

    `next_row` closes a stretch at the first row that leaves the state and falls back to the last
    row in it when the log ends there; `last_true` always closes at the last row in the state.
    """
    if close not in ("next_row", "last_true"):
        raise ValueError(f"close must be next_row or last_true, not {close}")
    keys = names(by)
    o = Ordered.of(df, by, t, tie).with_columns(__on=F.coalesce(holds, F.lit(False)))
    o = o.prev(__was="__on").next(__leave=t)
    o = o.islands("__isl", F.col("__on") & ~F.coalesce("__was", F.lit(False)))
    spans = o.df.where("__on").groupBy(*keys, F.col("__isl").alias("seq")).agg(
        F.min(t).alias("start"),
        F.max(t).alias("__last"),
        F.max_by("__leave", F.struct(t, *names(tie))).alias("__leave"),
        F.count(F.lit(1)).alias("n"),
    )
    end = F.coalesce("__leave", "__last") if close == "next_row" else F.col("__last")
    return spans.select(*keys, "seq", "start", end.alias("end"), "n")


def runs(df: DataFrame, by, t: str, tie, holds: Column, *, min_rows: int = 1, min_duration: float = 0,
         **aggregates: Column) -> DataFrame:
    """Runs of consecutive rows holding a condition, with row count, duration and any aggregates."""
    keys = names(by)
    o = Ordered.of(df, by, t, tie).with_columns(__on=F.coalesce(holds, F.lit(False)))
    o = o.prev(__was="__on").islands("__isl", F.col("__on") & ~F.coalesce("__was", F.lit(False)))
    found = o.df.where("__on").groupBy(*keys, F.col("__isl").alias("seq")).agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"),
        *[c.alias(n) for n, c in aggregates.items()],
    ).withColumn("duration", F.col("end") - F.col("start"))
    return found.where((F.col("n") >= min_rows) & (F.col("duration") >= min_duration))


def longest_run(df: DataFrame, by, t: str, tie, holds: Column) -> DataFrame:
    """The longest time a condition is held without interruption, per entity."""
    keys = names(by)
    return runs(df, by, t, tie, holds).groupBy(*keys).agg(
        F.max("duration").alias("longest"),
        F.min_by("start", F.struct(-F.col("duration"), "start")).alias("start"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def consecutive(df: DataFrame, by, t: str, tie, value, sign: int, k: int) -> DataFrame:
    """First stretch of at least k rows in a row that each rise (sign 1) or fall (sign -1).

    `base` is the time of the row before the first change of that stretch.
    """
    keys = names(by)
    o = Ordered.of(df, by, t, tie).with_columns(__v=as_column(value)).prev(__pv="__v", __pt=t)
    moves = F.coalesce((F.col("__v") - F.col("__pv")) * sign > 0, F.lit(False))
    o = o.with_columns(__mv=moves).prev(__pm="__mv")
    o = o.islands("__isl", F.col("__mv") & ~F.coalesce("__pm", F.lit(False)))
    found = o.df.where("__mv").groupBy(*keys, "__isl").agg(
        F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("n"),
        F.min("__pt").alias("base"),
    ).where(F.col("n") >= k)
    first = F.min_by(F.struct("base", "start", "end", "n"), "start").alias("__f")
    return found.groupBy(*keys).agg(first).select(*keys, "__f.*")


def change_points(df: DataFrame, by, t: str, tie, value) -> DataFrame:
    """Rows whose value differs from the previous row's; the first row counts as a change."""
    o = Ordered.of(df, by, t, tie).with_columns(__v=as_column(value))
    o = o.prev(previous="__v", __seen=F.lit(True))
    changed = F.col("__seen").isNull() | ~F.col("__v").eqNullSafe(F.col("previous"))
    return o.df.where(changed).drop("__v", "__seen")


def ordered_sequence(df: DataFrame, by, t: str, tie, value, wanted: list) -> DataFrame:
    """Places where the change points run through `wanted` one after the other: by, start, end."""
    keys = names(by)
    steps = change_points(df, by, t, tie, value).select(*keys, t, *names(tie), as_column(value).alias("__v"))
    o = Ordered.of(steps, by, t, tie)
    walk = {}
    for back in range(1, len(wanted)):
        source = "__v" if back == 1 else f"__v{back - 1}"
        time = t if back == 1 else f"__t{back - 1}"
        o = o.prev(**{f"__v{back}": source, f"__t{back}": time})
        walk[back] = (f"__v{back}", f"__t{back}")
    match = F.col("__v").eqNullSafe(F.lit(wanted[-1]))
    for back, (v, _) in walk.items():
        match = match & F.col(v).eqNullSafe(F.lit(wanted[-1 - back]))
    start = F.col(walk[len(wanted) - 1][1]) if walk else F.col(t)
    return o.df.where(match).select(*keys, start.alias("start"), F.col(t).alias("end"))


def listed_sequence(df: DataFrame, by, t: str, tie, level: str, lists: DataFrame, wanted: str, longest: int = 16) -> DataFrame:
    """Rows at which the last change points of an entity are the values its list `wanted` names, in order.

    `lists` has one row per entity; lists have at most `longest` values, longer ones raise an error.
    """
    keys = names(by)
    changes = change_points(df, by, t, tie, F.col(level)).drop("previous")
    o = Ordered.of(changes, by, t, tie).rows(longest - 1, 0, __last=lambda w: F.collect_list(level).over(w))
    size = F.size(wanted)
    checked = F.when(size > longest, F.raise_error(F.lit(f"a list of more than {longest} values"))).otherwise(size)
    joined = o.df.join(lists, keys).withColumn("__n", checked)
    hit = (F.col("__n") > 0) & (F.size("__last") >= F.col("__n")) & (F.slice("__last", F.greatest(F.size("__last") - F.col("__n") + 1, F.lit(1)), F.greatest("__n", F.lit(0))) == F.col(wanted))
    return joined.where(hit).select(*keys, t, *names(tie), level)


def settle_time(df: DataFrame, by, t: str, tie, in_band: Column) -> DataFrame:
    """First in-band time after the last out-of-band time, per entity; null when never settled."""
    keys = names(by)
    inside = F.coalesce(in_band, F.lit(False))
    o = Ordered.of(df, by, t, tie).with_columns(__in=inside).next(__nt=F.struct(F.col(t).alias("t"), F.col("__in").alias("ok")))
    first = F.min_by(F.struct(F.col(t).alias("t"), F.col("__in").alias("ok")), F.struct(t, *names(tie)))
    last_out = F.max_by("__nt", F.when(~F.col("__in"), F.struct(t, *names(tie))))
    ends = o.df.groupBy(*keys).agg(
        F.min(t).alias("begin"), first.alias("__f"), last_out.alias("__n"),
        F.count_if(~F.col("__in")).alias("n_out"),
    )
    settled = F.when(F.col("n_out") == 0, F.col("__f.t")).otherwise(F.col("__n.t"))
    return ends.select(*keys, "begin", settled.alias("settled"), "n_out")


def in_intervals(samples: DataFrame, intervals: DataFrame, by, t: str, tie, *, start: str = "start",
                 end: str = "end", carry: tuple[str, ...] = (), lead_in: float = 0, lead_out: float = 0) -> DataFrame:
    """Samples with the interval they lie in (bounds included), found by last known start.

    The intervals of one entity must not overlap, as those of `state_intervals` do not. Interval
    columns come back as `start`, `end` and the names in `carry`; null outside of every interval.
    No side is broadcast and a hot entity is cut in time, so neither side has a size limit.
    `lead_in` and `lead_out` shrink (positive) or widen (negative) the interval at its ends.
    """
    keys = names(by)
    row = F.struct(*samples.columns)
    opened = F.col(start) + F.lit(lead_in)
    fence = F.struct(opened.alias("start"), (F.col(end) - F.lit(lead_out)).alias("end"), *carry)
    events = samples.select(*keys, F.col(t).alias("__t"), F.lit(1).alias("__side"), row.alias("__row")).unionByName(
        intervals.select(*keys, opened.alias("__t"), F.lit(0).alias("__side"), fence.alias("__fence")),
        allowMissingColumns=True,
    )
    # intervals are fewer than samples, so the samples alone tell how to spread the work
    o = Ordered(events, by, "__t", "__side", chunk_width(samples, keys, t)).running(__open=("last", "__fence"))
    held = F.when(F.col("__t") <= F.col("__open.end"), F.col("__open"))
    out = o.df.where(F.col("__side") == 1).withColumn("__hit", held)
    return out.select("__row.*", *[F.col(f"__hit.{c}").alias(c) for c in ("start", "end", *carry)])
