"""Resampling of tracks and what is measured on resampled tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sequential
from .asof import asof_join
from .ordered import Ordered, gridded, names

SPLINE_ROWS, SPLINE_HALO = 192, 48
MERGE_FEET = 3.28           # fixed value: feet per metre in the distance of a lane merge


def resample_linear(df: DataFrame, by, t: str, tie, columns: list[str], step: float, *, tolerance: float = 0.0) -> DataFrame:
    """Values on the grid of multiples of `step` that lie inside the track (the last one left out).

    Every leg between two rows yields its own grid points, so a track is never held as a whole. A
    sample within the tolerance of a grid time is copied.
    """
    keys = names(by)
    ends = df.groupBy(*keys).agg(F.max(t).alias("__end"))
    o = Ordered.of(df.select(*keys, t, *names(tie), *columns), by, t, tie)
    o = o.next(__nt=t, **{f"__n_{c}": c for c in columns})
    legs = o.df.where(F.col("__nt") > F.col(t)).join(ends, keys)
    first = F.ceil(F.col(t) / F.lit(step)).cast("long")
    last = F.least(F.ceil(F.col("__nt") / F.lit(step)), F.floor(F.col("__end") / F.lit(step))).cast("long") - 1
    legs = legs.withColumn("__k", F.explode(F.when(last >= first, F.sequence(first, last))))
    at = F.col("__k") * F.lit(step)
    share = (at - F.col(t)) / (F.col("__nt") - F.col(t))
    value = lambda c: (
        F.when(F.abs(at - F.col(t)) < tolerance, F.col(c).cast("double"))
        .when(F.abs(F.col("__nt") - at) < tolerance, F.col(f"__n_{c}").cast("double"))
        .otherwise(F.col(c) + (F.col(f"__n_{c}") - F.col(c)) * share))
    return legs.select(*keys, at.alias("t"), *[value(c).alias(c) for c in columns])


def interpolate_at(df: DataFrame, times: DataFrame, by, t: str, columns: list[str], tie=()) -> DataFrame:
    """Linear values of a track at another stream's times; times outside the track are left out."""
    keys = names(by)
    track = df.select(*keys, t, *names(tie), F.struct(F.col(t).alias("t"), *columns).alias("__p"))
    back = asof_join(times, track, by, t, columns=["__p"], right_tie=tie)
    both = asof_join(back.withColumnRenamed("__p", "__a"), track, by, t, direction="forward", columns=["__p"], right_tie=tie)
    inside = both.where(F.col("__a").isNotNull() & F.col("__p").isNotNull())
    share = F.coalesce(F.try_divide(F.col(t) - F.col("__a.t"), F.col("__p.t") - F.col("__a.t")), F.lit(0.0))
    value = lambda c: F.col(f"__a.{c}") + (F.col(f"__p.{c}") - F.col(f"__a.{c}")) * share
    return inside.select(*times.columns, *[value(c).alias(c) for c in columns])


def spline_basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Values of all B-splines of a degree at points x, one row per point."""
    n = len(knots) - degree - 1
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, n - 1)
    out = np.zeros((len(x), n))
    basis = np.zeros((len(x), degree + 1))
    basis[:, 0] = 1.0
    for d in range(1, degree + 1):
        carried = np.zeros(len(x))
        for r in range(d):
            right, left = knots[span + r + 1], knots[span + r + 1 - d]
            part = basis[:, r] / (right - left)
            basis[:, r] = carried + (right - x) * part
            carried = (x - left) * part
        basis[:, d] = carried
    rows = np.arange(len(x))
    for r in range(degree + 1):
        out[rows, span - degree + r] = basis[:, r]
    return out


def spline_values(x: np.ndarray, values: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Interpolating spline through (x, values) at points `at`, knots at the inner samples."""
    half = (degree + 1) // 2
    knots = np.concatenate([np.full(degree + 1, x[0]), x[half:-half], np.full(degree + 1, x[-1])])
    weights = np.linalg.solve(spline_basis(x, knots, degree), values)
    return spline_basis(at, knots, degree) @ weights


def resample_spline(df: DataFrame, by, t: str, tie, columns: list[str], step: float, degree: int = 5) -> DataFrame:
    """Values of the interpolating spline of odd degree on multiples of `step` from the first row on.

    The spline is solved in blocks of rows with 48 more rows on both sides. What a sample adds to the
    spline fades by more than half per row, so a block differs from the whole solution by less than
    rounding. Tracks with too few rows for the degree yield nothing; nothing is extrapolated.
    """
    keys = names(by)
    single = df.groupBy(*keys, t).agg(*[F.min_by(c, F.struct(*names(tie)) if names(tie) else F.col(c)).alias(c) for c in columns])
    o = Ordered.of(single, by, t).number("__n")
    sized = o.df.join(single.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"), F.min(t).alias("__t0")), keys)
    sized = sized.where(F.col("__total") > degree)
    block = F.floor((F.col("__n") - 1) / SPLINE_ROWS)
    low = F.greatest(F.lit(0), F.floor((F.col("__n") - 1 - SPLINE_HALO) / SPLINE_ROWS))
    high = F.least(F.floor((F.col("__total") - 1) / SPLINE_ROWS), F.floor((F.col("__n") - 1 + SPLINE_HALO) / SPLINE_ROWS))
    spread = sized.withColumn("__block", F.explode(F.sequence(low, high))).withColumn("__own", block == F.col("__block"))
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("t", T.DoubleType())]
                          + [T.StructField(c, T.DoubleType()) for c in columns])
    fields = [f.name for f in schema.fields]

    def solve(x: np.ndarray, values: np.ndarray, own: np.ndarray, origin: float):
        """Grid times of a block and the values there."""
        if not own.any() or len(x) <= degree:
            return np.empty(0), np.empty((0, len(columns)))
        begin, last = x[own][0], np.flatnonzero(own)[-1]
        finish = x[last + 1] if last + 1 < len(x) else x[-1]
        at = origin + step * np.arange(np.ceil((begin - origin) / step), np.ceil((finish - origin) / step))
        at = at[(at >= begin) & (at < finish)]
        shift, scale = x[0], max(x[-1] - x[0], 1e-300)
        return at, spline_values((x - shift) / scale, values, (at - shift) / scale, degree)

    def solved(rows: pd.DataFrame, bounds: list) -> pd.DataFrame:
        x, values, own, origin = rows[t].to_numpy(dtype=float), rows[columns].to_numpy(dtype=float), rows["__own"].to_numpy(dtype=bool), rows["__t0"].to_numpy(dtype=float)
        parts = [solve(x[low:high], values[low:high], own[low:high], float(origin[low])) for low, high in bounds]
        found = np.concatenate([v for _, v in parts])
        from_row = np.repeat([low for low, _ in bounds], [len(at) for at, _ in parts])
        result = {key: rows[key].iloc[from_row].reset_index(drop=True) for key in keys}
        result |= {"t": np.concatenate([at for at, _ in parts]), **{c: found[:, i] for i, c in enumerate(columns)}}
        return pd.DataFrame(result)[fields]

    return sequential.streamed(spread, [*keys, "__block"], ["__n"], solved, schema)


def zone_times(track: DataFrame, by, t: str, tie, inside: Column) -> DataFrame:
    """First time inside a zone and first time outside after that, per entity. For a resampled track see `gridded`."""
    keys = names(by)
    o = Ordered.of(track, by, t, tie).with_columns(__in=F.coalesce(inside, F.lit(False)))
    o = o.running(__enter=("min", F.when(F.col("__in"), F.col(t))))
    out = F.when(~F.col("__in") & (F.col(t) > F.col("__enter")), F.col(t))
    return o.df.groupBy(*keys).agg(F.min("__enter").alias("t_enter"), F.min(out).alias("t_exit"))


def _beyond(x_line: float, y_line: float, direction: str) -> Column:
    rules = {
        "N": F.col("y") >= y_line, "S": F.col("y") <= y_line, "E": F.col("x") >= x_line, "W": F.col("x") <= x_line,
    }
    beyond = rules[direction[0]]
    for letter in direction[1:]:
        beyond = beyond & rules[letter]
    return beyond


def first_crossing(track: DataFrame, by, t: str, x_line: float, y_line: float, direction: str) -> DataFrame:
    """First time beyond a line in one of eight compass directions (x east, y north)."""
    return track.groupBy(*names(by)).agg(F.min(F.when(_beyond(x_line, y_line, direction), F.col(t))).alias("t_cross"))


def crossings(track: DataFrame, by, t: str, x_line: float, y_line: float) -> DataFrame:
    """First times beyond the lines in all eight directions, from one aggregate: by, direction, t_cross."""
    cells = [F.struct(F.lit(d).alias("direction"), F.min(F.when(_beyond(x_line, y_line, d), F.col(t))).alias("t_cross"))
             for d in ("N", "S", "E", "W", "NE", "SE", "SW", "NW")]
    return track.groupBy(*names(by)).agg(F.array(*cells).alias("__c")).select(*names(by), F.inline("__c"))


def track_error(a: DataFrame, b: DataFrame, by, t: str, tie, step: float) -> DataFrame:
    """Distance of two tracks at common grid times."""
    keys = names(by)
    one = resample_linear(a, by, t, tie, ["x", "y"], step)
    two = resample_linear(b, by, t, tie, ["x", "y"], step).select(*keys, "t", F.col("x").alias("__x"), F.col("y").alias("__y"))
    return one.join(two, [*keys, "t"]).withColumn("error", F.hypot(F.col("x") - F.col("__x"), F.col("y") - F.col("__y"))).drop("__x", "__y")


def max_speed(track: DataFrame, by, t: str, tie, unit: float, cap: float | None = None) -> DataFrame:
    """Greatest speed between consecutive rows, optionally limited to a cap."""
    o = Ordered.of(track, by, t, tie).prev(__px="x", __py="y", __pt=t)
    speed = F.try_divide(F.hypot(F.col("x") - F.col("__px"), F.col("y") - F.col("__py")), (F.col(t) - F.col("__pt")) / F.lit(unit))
    best = F.max(speed)
    return o.df.groupBy(*names(by)).agg((F.least(best, F.lit(cap)) if cap is not None else best).alias("max_speed"))


def encroachment(vehicle: DataFrame, walker: DataFrame, by, t: str, tie, *, zone: float, cell: float, enter_step: float,
                 exit_step: float, accel: float, top_speed: float, buffer: float, unit: float = 1000.0,
                 smooth: bool = True) -> DataFrame:
    """Post-encroachment time and the time expected from the distance left when the zone was cleared.

    The zone is a square around the first crossing of both paths. Expected: reach the conflict point
    from standstill with the given acceleration up to the vehicle's own top speed, plus a buffer.

    A grid has far more rows than its plan tells, so it must not be broadcast: the one row per entity is what tasks hold of a join with it.
    """
    from .spatial import conflict_point

    keys = names(by)
    sample = (lambda d, s: resample_spline(d, by, t, tie, ["x", "y"], s)) if smooth else (
        lambda d, s: resample_linear(d, by, t, tie, ["x", "y"], s))
    point = conflict_point(vehicle, walker, by, t, cell, tie).select(*keys, F.col("x").alias("__cx"), F.col("y").alias("__cy"))
    point = point.hint("shuffle_hash")
    half = F.lit(zone / 2)
    inside = (F.abs(F.col("x") - F.col("__cx")) < half) & (F.abs(F.col("y") - F.col("__cy")) < half)
    with gridded(walker, by, t, exit_step):
        walk = zone_times(sample(walker, exit_step).join(point, keys), by, "t", (), inside).select(*keys, F.col("t_exit").alias("walker_exit"))
    fine = sample(vehicle, enter_step).join(point, keys)
    drive = fine.groupBy(*keys).agg(F.min(F.when(inside, F.col("t"))).alias("vehicle_enter"))
    times = drive.join(walk, keys).where("vehicle_enter is not null and walker_exit is not null")
    with gridded(vehicle, by, t, enter_step):
        o = Ordered.of(fine.select(*keys, "t", "x", "y"), by, "t").prev(__px="x", __py="y")
    step = F.hypot(F.col("x") - F.col("__px"), F.col("y") - F.col("__py"))
    between = (F.col("t") > F.col("walker_exit")) & (F.col("t") < F.col("vehicle_enter"))
    left = o.df.join(times.hint("shuffle_hash"), keys).where(between).groupBy(*keys).agg(F.sum(step).alias("distance"))
    speeds = max_speed(vehicle, by, t, tie, unit, top_speed)
    full = times.join(left, keys, "left").join(speeds, keys)
    d, v = F.coalesce("distance", F.lit(0.0)), F.col("max_speed")
    ramp = v * v / (2 * accel)
    expected = F.when(ramp >= d, F.sqrt(2 * d / accel)).otherwise(v / accel + F.try_divide(d - ramp, v))
    return full.select(*keys, "vehicle_enter", "walker_exit", (F.col("vehicle_enter") - F.col("walker_exit")).alias("pet"),
                       d.alias("distance"), ((expected + F.lit(buffer)) * F.lit(unit)).alias("expected_pet"))


def merge_distance(points: DataFrame, by, t: str, tie, planner: str, merging: list[str], zone: tuple[float, float], least_step: float = 0.001) -> DataFrame:
    """Where the lane merge of a planned trajectory ends, and its distance to a zone in feet: by, x, y, feet.

    The merge ends at the last point of a merging planner before another planner's, or at the last point
    of the trajectory. A point less than `least_step` after the one before it is no such other point.
    """
    keys = names(by)
    merges = F.coalesce(F.col(planner).isin(merging), F.lit(False))
    o = Ordered.of(points, by, t, tie).with_columns(__m=merges).prev(__pt=t).next(__nt=t, __nm="__m")
    leaves = F.col("__m") & ~F.col("__nm") & (F.col("__nt") - F.col(t) > least_step)
    ends = F.col("__m") & F.col("__nt").isNull() & (F.col(t) - F.col("__pt") > least_step)
    first = F.min_by(F.struct("x", "y"), F.struct(t, *names(tie))).alias("__e")
    out = o.df.where(F.coalesce(leaves, F.lit(False)) | F.coalesce(ends, F.lit(False))).groupBy(*keys).agg(first).select(*keys, "__e.*")
    return out.withColumn("feet", F.hypot(F.col("x") - F.lit(zone[0]), F.col("y") - F.lit(zone[1])) * F.lit(MERGE_FEET))


def resample_by_length(df: DataFrame, by, t: str, tie, step: float, degree: int = 3) -> DataFrame:
    """Points of the cubic spline of a path over the way along it: by, s, x, y at multiples of `step`."""
    from .rolling import path_length

    along = path_length(df, by, t, tie, "x", "y", name="s")
    return resample_spline(along.select(*names(by), F.col("s").cast("double").alias("s"), t, *names(tie), "x", "y"), by, "s", [t, *names(tie)], ["x", "y"], step, degree).withColumnRenamed("t", "s")
