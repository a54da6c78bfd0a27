"""As-of joins: the row of another stream in effect at, before, after or nearest to a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Ordered, chunk_width, names


def asof_join(left: DataFrame, right: DataFrame, by, t: str, *, direction: str = "backward",
              allow_exact: bool = True, tolerance: float | None = None, columns: list[str] | None = None,
              right_tie=(), suffix: str = "") -> DataFrame:
    """Left rows with the matching right row's columns (null when there is none).

    backward: last right row at or before the time; forward: first at or after it; nearest: the
    closer of the two, the later one when equally close. Among right rows of equal time the last in
    `right_tie` order wins backward and the first wins forward. allow_exact=False asks for strictly
    earlier or later rows. Both streams are put in one order once, so the cost is one shuffle.
    """
    keys = names(by)
    taken = columns if columns is not None else [c for c in right.columns if c not in [*keys, t, *names(right_tie)]]
    found = F.struct(F.col(t).alias("__rt"), *[F.col(c) for c in taken])
    ties = [F.col(c).alias(f"__tie{i}") for i, c in enumerate(names(right_tie))]
    tie_names = [f"__tie{i}" for i in range(len(ties))]
    ways = {"backward": ["backward"], "forward": ["forward"], "nearest": ["backward", "forward"]}
    if direction not in ways:
        raise ValueError(f"direction must be backward, forward or nearest, not {direction}")
    result = left.select(*keys, t, F.struct(*left.columns).alias("__row"))
    width = chunk_width(left.select(*keys, t).unionByName(right.select(*keys, t)), keys, t)
    for way in ways[direction]:
        result = _one_way(result, right, keys, t, found, ties, tie_names, way, allow_exact, width)
    near = _choose(direction, t)
    if tolerance is not None:
        near = F.when(F.abs(near["__rt"] - F.col(t)) <= tolerance, near)
    out = result.withColumn("__hit", near)
    return out.select("__row.*", *[F.col("__hit")[c].alias(c + suffix) for c in taken])


def _one_way(rows, right, keys, t, found, ties, tie_names, way, allow_exact, width) -> DataFrame:
    # equal times: right rows stand before the left row exactly when it may see them
    right_first = (way == "backward") == allow_exact
    place_left, place_right = (1, 0) if right_first else (0, 1)
    a = rows.withColumn("__place", F.lit(place_left))
    b = right.select(*keys, t, *ties, F.lit(place_right).alias("__place"), found.alias("__r"))
    o = Ordered(a.unionByName(b, allowMissingColumns=True), keys, t, ["__place", *tie_names], width)
    o = o.running(__back=("last", "__r")) if way == "backward" else o.ahead(__ahead="__r")
    return o.df.where(F.col("__row").isNotNull()).drop("__place", "__r", *tie_names)


def _choose(direction: str, t: str):
    if direction == "backward":
        return F.col("__back")
    if direction == "forward":
        return F.col("__ahead")
    gap_back, gap_ahead = F.col(t) - F.col("__back.__rt"), F.col("__ahead.__rt") - F.col(t)
    earlier = F.col("__ahead").isNull() | (gap_back < gap_ahead)
    return F.when(F.col("__back").isNotNull() & earlier, F.col("__back")).otherwise(F.col("__ahead"))


def last_known(main: DataFrame, state: DataFrame, by, t: str, columns: list[str], *, tie=(), default=None) -> DataFrame:
    """Main rows with the last value of another topic at or before them, or a default before any."""
    joined = asof_join(main, state, by, t, columns=columns, right_tie=tie)
    if default is None:
        return joined
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in columns})


def clock_at(events: DataFrame, clock: DataFrame, by, t: str, value: str, rule: str = "in_effect") -> DataFrame:
    """Value of another clock at each event: the entry in effect, or the next entry (strictly later)."""
    if rule == "in_effect":
        return asof_join(events, clock, by, t, columns=[value])
    if rule == "next":
        return asof_join(events, clock, by, t, direction="forward", allow_exact=False, columns=[value])
    raise ValueError(f"rule must be in_effect or next, not {rule}")
