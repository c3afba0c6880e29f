import datetime as dt
import math
import struct

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from rillflow.functions import geo, physics, sections, text, times


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_numbers_are_written_as_python_writes_them(spark):
    numbers = [7.5e-05, 1e16, 1.0, 12345678.5, 1e15, 0.0001, 280.3722222222222, -0.00051, 3.38e-06, 1.5e-300, 6.595832e16, 2e-3, 0.0, -2.0]
    got = values(spark, [(n,) for n in numbers], "v double", text.python_float(F.col("v")))
    assert [g[0] for g in got] == [repr(n) for n in numbers]
    assert values(spark, [(None,), (math.nan,)], "v double", text.python_float(F.col("v"))) == [("nan",), ("nan",)]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("2021", dt.datetime(2021, 1, 1)),
        ("2021-12", dt.datetime(2021, 12, 1)),
        ("2021-12-31", dt.datetime(2021, 12, 31)),
        ("2021-12-31 14", dt.datetime(2021, 12, 31, 14)),
        ("2021-12-31 14:05", dt.datetime(2021, 12, 31, 14, 5)),
        ("2021-12-31 14:05:06", dt.datetime(2021, 12, 31, 14, 5, 6)),
        ("2021-12-31T14:05:06.25", dt.datetime(2021, 12, 31, 14, 5, 6, 250000)),
        ("2021-12-31T14:05:06", None),
        ("yesterday", None),
    ],
)
def test_times_in_seven_spellings(spark, given, expected):
    assert values(spark, [(given,)], "t string", times.parse_time(F.col("t"))) == [(expected,)]


def test_strict_times_fail(spark):
    with pytest.raises(SparkRuntimeException, match="not a valid time"):
        values(spark, [("x",)], "t string", times.parse_time_strict(F.col("t")))


def test_zones_become_utc_in_any_session_zone(spark):
    rows = [("2021-03-14 02:30:00-08:00",), ("2021-03-14T02:30:00Z",), ("2021-03-14 02:30",), ("2021-03-14",), ("2021-03-14T02:30:00.5-0800",)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = values(spark, rows, "t string", times.to_naive_utc(F.col("t")).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [g[0] for g in got] == [
        "2021-03-14 10:30:00", "2021-03-14 02:30:00", "2021-03-14 02:30:00", "2021-03-14 00:00:00", "2021-03-14 10:30:00.5",
    ]


def clean_by_loop(y, threshold=100.0):
    y = list(y)
    for i in [k for k, v in enumerate(y) if v > threshold]:
        if 0 < i < len(y) - 1:
            y[i] = (y[i - 1] + y[i + 1]) / 2
        elif i == 0:
            y[i] = y[1] if len(y) > 1 else None
        else:
            y[i] = y[i - 1]
    return y


@pytest.mark.parametrize("y", [[1.0, 2.0, 3.0], [500.0, 2.0, 300.0], [1.0, 150.0, 200.0, 2.0], [1.0, 400.0, 400.0, 400.0, 5.0], [200.0, 300.0, 1.0], [900.0]])
def test_elevations_are_repaired_from_left_to_right(spark, y):
    assert values(spark, [(y,)], "y array<double>", sections.clean_elevations(F.col("y"))) == [(clean_by_loop(y),)]


def test_area_of_a_triangle_and_of_unordered_points(spark):
    points = [(0.0, 2.0), (2.0, 0.0), (1.0, 1.0), (4.0, 2.0)]
    got = values(spark, [(points,)], "p array<struct<x:double,Y:double>>", sections.area_below(F.col("p"), F.lit(2.0)))
    assert got == [(4.0,)]


def test_survey_text_is_parsed(spark):
    got = values(spark, [("[(0.0, 1.5), (1.0, -2.0)]", "['0.5', '3.0']")], "p string, b string", text.point_list(F.col("p")), text.number_list(F.col("b")))
    assert [tuple(p) for p in got[0][0]] == [(0.0, 1.5), (1.0, -2.0)]
    assert got[0][1] == [0.5, 3.0]


def test_projection_origin_and_pressure(spark):
    lon, lat = geo.albers_to_lonlat(F.col("x"), F.col("y"))
    (got,) = values(spark, [(0.0, 0.0)], "x double, y double", lon, lat, physics.standard_pressure(F.lit(0.0)))
    assert got == pytest.approx((-96.0, 23.0, 101325.0), abs=1e-7)
    (far,) = values(spark, [(-1.0e6, 2.0e6)], "x double, y double", lon, lat)
    # Snyder's forward formulas on the result must give the point back.
    assert forward(*far) == pytest.approx((-1.0e6, 2.0e6), abs=1e-3)


def forward(lon, lat):
    e2 = 2 / 298.257222101 - (1 / 298.257222101) ** 2
    e = math.sqrt(e2)

    def q(p):
        s = math.sin(p)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m2(p):
        return math.cos(p) ** 2 / (1 - e2 * math.sin(p) ** 2)

    p1, p2, p0 = map(math.radians, (29.5, 45.5, 23.0))
    n = (m2(p1) - m2(p2)) / (q(p2) - q(p1))
    c = m2(p1) + n * q(p1)
    rho, rho0 = (6378137.0 * math.sqrt(c - n * q(p)) / n for p in (math.radians(lat), p0))
    theta = n * math.radians(lon + 96)
    return rho * math.sin(theta), rho0 - rho * math.cos(theta)


def test_albedo_of_unknown_cover_fails(spark):
    assert values(spark, [("snow",), ("ice",), ("other",)], "c string", physics.landcover_albedo(F.col("c"))) == [(0.75,), (0.3,), (0.2,)]
    with pytest.raises(SparkRuntimeException, match="unknown land cover"):
        values(spark, [("lava",)], "c string", physics.landcover_albedo(F.col("c")))


def test_envelopes_of_all_geometry_kinds(spark):
    point = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    line = struct.pack(">BII4d", 0, 2, 2, 1.0, 9.0, -5.0, 2.0)
    with_z = struct.pack("<BII6d", 1, 1002, 2, 0.0, 0.0, 99.0, 1.0, 2.0, 99.0)
    polygon = struct.pack("<BIII8d", 1, 3, 1, 4, 0, 0, 4, 0, 4, 3, 0, 0)
    both = struct.pack("<BII", 1, 7, 2) + point + polygon
    rows = [(g,) for g in (point, line, with_z, polygon, both, None)]
    got = [tuple(r[0]) for r in values(spark, rows, "g binary", geo.wkb_bounds("g"))]
    assert got == [(3, 4, 3, 4), (-5, 2, 1, 9), (0, 0, 1, 2), (0, 0, 4, 3), (0, 0, 4, 4), (None,) * 4]


def krueger_forward(lon, lat, zone):
    """Snyder's series from degrees to metres of a transverse zone, good to a millimetre near its meridian."""
    e2 = geo._E2
    ep = e2 / (1 - e2)

    def arc(p):
        return geo._A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * p)
                         + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * p) - 35 * e2**3 / 3072 * math.sin(6 * p))

    phi = math.radians(lat)
    n, t, c = geo._A / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, ep * math.cos(phi) ** 2
    a = math.radians(lon - zone.lon) * math.cos(phi)
    x = zone.scale * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120)
    y = zone.scale * (arc(phi) - arc(math.radians(zone.lat)) + n * math.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720))
    return x + zone.east, y + zone.north


def hotine_forward(lon, lat, zone):
    a, b, h, gamma, lon0, azimuth = zone.constants()
    phi, e = math.radians(lat), geo._E
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - e * math.sin(phi)) / (1 + e * math.sin(phi))) ** (e / 2)
    q = h / t**b
    s, tt = (q - 1 / q) / 2, (q + 1 / q) / 2
    turn = b * math.radians(lon - lon0)
    v = math.sin(turn)
    u = (-v * math.cos(gamma) + s * math.sin(gamma)) / tt
    across = a / (2 * b) * math.log((1 - u) / (1 + u))
    along = a / b * math.atan2(s * math.cos(gamma) + v * math.sin(gamma), math.cos(turn))
    return (across * math.cos(azimuth) + along * math.sin(azimuth) + zone.east, along * math.cos(azimuth) - across * math.sin(azimuth) + zone.north)


def test_mercator_zones_come_back_from_their_forward_formulas(spark):
    rows, want = [], {}
    for code, zone in geo.STATE_PLANE.items():
        if isinstance(zone, geo.Lambert):
            continue
        forward = hotine_forward if isinstance(zone, geo.Oblique) else krueger_forward
        for k, (dlon, dlat) in enumerate([(0.0, 0.0), (0.7, 1.5), (-1.1, 3.0), (0.4, -0.3)]):
            lon, lat = zone.lon + dlon, zone.lat + dlat
            rows.append((code, k, *forward(lon, lat, zone)))
            want[code, k] = (lon, lat)
    df = spark.createDataFrame(rows, "code int, k int, x double, y double")
    found = geo.with_survey_lonlat(df, "x", "y", F.col("code"), geo.STATE_PLANE)
    got = {(r.code, r.k): (r._survey_lon, r._survey_lat) for r in found.collect()}
    assert set(got) == set(want) and len(want) == 44
    for key, place in want.items():
        assert got[key] == pytest.approx(place, abs=2e-8), key  # two millimetres
    origin = geo.STATE_PLANE[26967]
    assert krueger_forward(origin.lon, origin.lat, origin) == (700_000, 0)
