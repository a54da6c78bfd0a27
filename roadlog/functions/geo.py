"""Distances, bearings and plane transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111111.0
WGS84_FLATTENING = 1 / 298.257223563


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial spherical bearing in degrees, 0 to 360 (within 0.2 degrees of the ellipsoidal one)."""
    turn = F.radians(lon2 - lon1)
    y = F.sin(turn) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + F.lit(360.0), F.lit(360.0))


def azimuth(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing on the WGS84 ellipsoid in degrees, 0 to 360.

    It is the direction of the second point in the horizon plane of the first one, within a thousandth of a
    degree of the geodesic up to some hundred kilometres.
    """
    e2 = F.lit(WGS84_FLATTENING * (2 - WGS84_FLATTENING))
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    radius = lambda x: F.lit(1.0) / F.sqrt(F.lit(1.0) - e2 * F.sin(x) * F.sin(x))
    n1, n2 = radius(a), radius(b)
    across = n2 * F.cos(b) * F.cos(turn) - n1 * F.cos(a)
    up = (F.lit(1.0) - e2) * (n2 * F.sin(b) - n1 * F.sin(a))
    east, north = n2 * F.cos(b) * F.sin(turn), F.cos(a) * up - F.sin(a) * across
    return F.pmod(F.degrees(F.atan2(east, north)) + F.lit(360.0), F.lit(360.0))


def to_plane(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """East and north metres from an origin, on the local plane."""
    east = (lon - F.lit(lon0)) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(F.lit(lat0)))
    return east, (lat - F.lit(lat0)) * F.lit(METRES_PER_DEGREE)


def from_plane(east: Column, north: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Latitude and longitude of a point of the local plane."""
    lon = F.lit(lon0) + east / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(F.lit(lat0))))
    return F.lit(lat0) + north / F.lit(METRES_PER_DEGREE), lon


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Cross product of a to b with a to p: positive when p lies to the left."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def homography(x: Column, y: Column, h: list[list[float]]) -> tuple[Column, Column]:
    """Plane-to-plane transform by a 3 x 3 matrix."""
    row = lambda r: F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2]))
    w = row(h[2])
    return F.try_divide(row(h[0]), w), F.try_divide(row(h[1]), w)


def shadow_point(x: Column, y: Column, x0: float, y0: float, object_height: float, camera_height: float) -> tuple[Column, Column]:
    """Where a point at a height appears on the ground for a camera above (x0, y0)."""
    longer = F.lit(camera_height / (camera_height - object_height) - 1.0)
    return x + (x - F.lit(x0)) * longer, y + (y - F.lit(y0)) * longer


def heading_mirror(heading: Column) -> Column:
    """Counter-clockwise to clockwise heading, 0 to 360."""
    return F.pmod(F.lit(360.0) - heading, F.lit(360.0))
