"""Accuracy of a roadside sensor against reference tracks, and its rate and id stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import MPS_TO_MPH
from ..operators import rolling, spatial, trajectory
from ..operators.ordered import Ordered, gridded, names
from ..session import cut

# fixed values: m, mph, degrees, Hz, percent
POSITION_LIMIT, SPEED_LIMIT, HEADING_LIMIT, LOWEST_RATE, SHARE = 0.3, 3.0, 3.0, 27.0, 90.0


def matched_tracks(sensor: DataFrame, reference: DataFrame, by, t: str, tie, step: float, search: int | None = None) -> DataFrame:
    """Both tracks on one grid, the sensor's moved to the row offset with the least mean distance.

    Tracks have x, y, speed and heading; heading is unwrapped before it is resampled.
    """
    keys, columns = names(by), ["x", "y", "speed", "heading"]

    def grid(track):
        smooth = rolling.unwrap(track, by, t, tie, "heading", 360, 270).drop("heading").withColumnRenamed("unwrapped", "heading")
        even = trajectory.resample_linear(smooth, by, t, tie, columns, step)
        with gridded(track, by, t, step):
            return Ordered.of(even, by, "t").number("i").df

    a, b = cut(grid(reference)), cut(grid(sensor))      # both are read by the search and by the match
    best = spatial.track_offset(a.select(*keys, "i", "x", "y"), b.select(*keys, "i", "x", "y"), by, "i", search)
    moved = b.join(best, keys).select(*keys, (F.col("i") + F.col("offset")).alias("i"), "offset", *[F.col(c).alias(f"s_{c}") for c in columns])
    return a.join(moved, [*keys, "i"])


def accuracy(matched: DataFrame, by, limits=(POSITION_LIMIT, SPEED_LIMIT, HEADING_LIMIT), share: float = SHARE) -> DataFrame:
    """Mean, deviation, share under the limit and verdict of position, speed and heading errors."""
    turn = F.abs(F.col("heading") - F.col("s_heading")) % 360
    errors = {
        "position": F.hypot(F.col("x") - F.col("s_x"), F.col("y") - F.col("s_y")),
        "speed": F.abs(F.col("speed") - F.col("s_speed")) * F.lit(MPS_TO_MPH),
        "heading": F.least(turn, 360 - turn),
    }
    cells = []
    for (name, error), limit in zip(errors.items(), limits):
        under = F.count_if(error < limit) * 100.0 / F.count(error)
        cells.append(F.struct(F.lit(name).alias("measure"), F.avg(error).alias("mean"), F.stddev_pop(error).alias("sd"), under.alias("pct_under")))
    return matched.groupBy(*names(by)).agg(F.array(*cells).alias("__m")).select(*names(by), F.inline("__m")).withColumn("passed", F.col("pct_under") >= share)


def detection_rate(sensor: DataFrame, by, t: str, unit: float, lowest: float = LOWEST_RATE, share: float = SHARE) -> DataFrame:
    """Mean detection frequency and share of periods faster than the lowest rate."""
    seen = sensor.select(*names(by), t).distinct()
    o = Ordered.of(seen, by, t).prev(__pt=t).with_columns(gap=(F.col(t) - F.col("__pt")) / F.lit(unit))
    fast = F.count_if(F.col("gap") < 1.0 / lowest) * 100.0
    return o.df.groupBy(*names(by)).agg(
        F.try_divide(F.lit(1.0), F.avg("gap")).alias("frequency"), F.stddev_pop(F.try_divide(F.lit(1.0), F.col("gap"))).alias("frequency_sd"),
        F.try_divide(fast, F.count("gap")).alias("pct_fast")).withColumn("passed", F.col("pct_fast") >= share)


def confidence(sensor: DataFrame, entity: str, by, value: str, least: float = 90.0, share: float = SHARE) -> DataFrame:
    """Mean confidence per track and share of tracks that are confident in most rows."""
    per = sensor.groupBy(*names(by), entity).agg(F.avg(value).alias("m"), (F.count_if(F.col(value) > least) * 100.0 / F.count(value)).alias("p"))
    return per.groupBy(*names(by)).agg(
        F.avg("m").alias("mean"), (F.count_if(F.col("p") > share) * 100.0 / F.count(F.lit(1))).alias("pct_tracks")
    ).withColumn("passed", F.col("pct_tracks") >= share)
