"""Unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
KPH_TO_MPS = 0.277777
MPS_TO_MPH = 2.23694
MPH_TO_MPS = 0.44704
METRES_TO_FEET = 3.28084
DECIMETRES_TO_METRES = 0.1
NS_PER_S = 1_000_000_000
US_PER_S = 1_000_000


def kph_to_mps(c: Column) -> Column:
    return c * F.lit(KPH_TO_MPS)


def mps_to_mph(c: Column) -> Column:
    return c * F.lit(MPS_TO_MPH)


def mph_to_mps(c: Column) -> Column:
    return c * F.lit(MPH_TO_MPS)


def metres_to_feet(c: Column) -> Column:
    return c * F.lit(METRES_TO_FEET)


def decimetres_to_metres(c: Column) -> Column:
    return c * F.lit(DECIMETRES_TO_METRES)


def dead_band(c: Column, least: float) -> Column:
    """Zero below a least magnitude."""
    return F.when(F.abs(c) < least, F.lit(0.0)).otherwise(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def close_to(a: Column, b, eps: float) -> Column:
    return F.abs(a - (F.lit(b) if not isinstance(b, Column) else b)) < eps


def required_rate(v0: Column, v1: Column, d: Column) -> Column:
    """Constant acceleration that takes v0 to v1 over a distance."""
    return F.try_divide(v1 * v1 - v0 * v0, 2 * d)
