"""Scalar functions against known values."""

import datetime

import pytest
from pyspark.sql import functions as F

from roadlog.functions import clock, geo, text, units


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_geo(spark):
    lit = F.lit
    assert one(spark, geo.haversine(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(111194.9, abs=0.1)
    assert one(spark, geo.bearing(lit(0.0), lit(0.0), lit(1.0), lit(0.0))) == pytest.approx(0)
    assert one(spark, geo.bearing(lit(0.0), lit(0.0), lit(0.0), lit(-1.0))) == pytest.approx(270)
    lat, lon = geo.from_plane(lit(30.0), lit(40.0), 47.6, -122.1)
    east, north = geo.to_plane(lat, lon, 47.6, -122.1)
    assert (one(spark, east), one(spark, north)) == (pytest.approx(30, abs=1e-6), pytest.approx(40, abs=1e-6))
    assert one(spark, geo.side(lit(0.0), lit(0.0), lit(1.0), lit(0.0), lit(0.5), lit(1.0))) > 0
    x, _ = geo.shadow_point(lit(9.0), lit(0.0), 0.0, 0.0, 0.5, 5.0)
    assert one(spark, x) == pytest.approx(10)


def test_clocks(spark):
    utc = datetime.timezone.utc
    ms = lambda *a: int(datetime.datetime(*a, tzinfo=utc).timestamp() * 1000)
    assert one(spark, clock.minute_of_year_ms(F.lit(61), F.lit(250), 2023, "America/New_York")) == ms(2023, 1, 1, 6, 1) + 250
    assert one(spark, clock.minute_of_year_ms(F.lit(2), F.lit(5), 2023, "UTC", simulation=True)) == 120005
    stamp = F.struct(F.lit(2023).alias("year"), F.lit(7).alias("month"), F.lit(4).alias("day"), F.lit(10).alias("hour"),
                     F.lit(30).alias("minute"), F.lit(15123).alias("second"))
    assert one(spark, clock.date_struct_ms(stamp, "America/New_York")) == ms(2023, 7, 4, 14, 30, 15) + 123
    assert one(spark, clock.gps_ms(F.lit("040723"), F.lit(3600.25))) == ms(2023, 7, 4, 1) + 250
    assert one(spark, clock.time_of_day_ms(F.lit("23:59:59,999"))) == 86_399_999
    assert one(spark, clock.shift_ms(F.lit(5.0), F.lit(7.0))) is None


def test_text(spark):
    assert one(spark, text.hex_id(F.array(F.lit(16), F.lit(0), F.lit(255), F.lit(-1)))) == "1000ffff"
    assert one(spark, text.unescape(F.lit("\\u003ca\\u003e\\n"))) == "<a>"
    status = F.lit("A: 1,B : x y , A:2")
    assert [one(spark, text.field_of(status, n)) for n in ("A", "B", "C")] == ["2", "x y", None]
    rules = [(F.lit(True), "first"), (F.lit(True), "second"), (F.lit(False), "third")]
    assert one(spark, text.last_rule(rules)) == "second" and one(spark, text.first_rule(rules)) == "first"
    assert one(spark, text.decode(F.lit(9), {4: "pedestrian"})) == "other"


def test_units(spark):
    assert one(spark, units.required_rate(F.lit(10.0), F.lit(0.0), F.lit(25.0))) == -2.0
    assert one(spark, units.required_rate(F.lit(10.0), F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, units.dead_band(F.lit(0.05), 0.1)) == 0.0
