"""Map projection and envelopes."""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

# EPSG:5070, Albers equal-area on GRS80 for the conterminous United States.
_A = 6378137.0
_F = 1 / 298.257222101
_PARALLELS = (29.5, 45.5)
_ORIGIN = (23.0, -96.0)

_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(sine: float) -> float:
    return (1 - _E2) * (sine / (1 - _E2 * sine * sine) - math.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E))


def _m2(phi: float) -> float:
    return math.cos(phi) ** 2 / (1 - _E2 * math.sin(phi) ** 2)


_PHI1, _PHI2 = (math.radians(p) for p in _PARALLELS)
_N = (_m2(_PHI1) - _m2(_PHI2)) / (_q(math.sin(_PHI2)) - _q(math.sin(_PHI1)))
_C = _m2(_PHI1) + _N * _q(math.sin(_PHI1))
_RHO0 = _A * math.sqrt(_C - _N * _q(math.sin(math.radians(_ORIGIN[0])))) / _N
_QP = _q(1.0)

# Series from authalic to geodetic latitude (Snyder 1987, eq. 3-18).
_SERIES = (
    _E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040,
    23 * _E2**2 / 360 + 251 * _E2**3 / 3780,
    761 * _E2**3 / 45360,
)


def albers_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:5070 metres to longitude and latitude in degrees (NAD83 taken as WGS84)."""
    up = F.lit(_RHO0) - y
    rho2 = x * x + up * up
    theta = F.atan2(x, up)
    q = (F.lit(_C) - rho2 * (_N * _N / (_A * _A))) / _N
    beta = F.asin(q / _QP)
    phi = beta
    for step, factor in enumerate(_SERIES, start=1):
        phi = phi + factor * F.sin(2 * step * beta)
    return F.degrees(theta / _N) + _ORIGIN[1], F.degrees(phi)


def lonlat_to_albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees (NAD83) to EPSG:5070 metres."""
    sine = F.sin(F.radians(lat))
    logarithm = F.ln((1 - _E * sine) / (1 + _E * sine)) / (2 * _E)
    q = (1 - _E2) * (sine / (1 - _E2 * sine * sine) - logarithm)
    rho = F.sqrt(F.lit(_C) - _N * q) * (_A / _N)
    theta = F.radians(lon - _ORIGIN[1]) * _N
    return rho * F.sin(theta), F.lit(_RHO0) - rho * F.cos(theta)


#: Metres in a US survey foot.
US_FOOT = 1200 / 3937


@dataclass(frozen=True)
class Lambert:
    """A conformal conic system with two standard parallels on GRS80; origin and offsets in degrees and metres."""

    lon: float
    lat: float
    parallels: tuple[float, float]
    east: float
    north: float
    unit: float = 1.0

    def cone(self) -> tuple[float, float, float]:
        """Cone constant, radius at the pole's scale (a F) and radius at the origin."""

        def t(lat: float) -> float:
            sine = math.sin(math.radians(lat))
            return math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - _E * sine) / (1 + _E * sine)) ** (_E / 2)

        one, two = self.parallels
        m1, m2 = (math.sqrt(_m2(math.radians(p))) for p in self.parallels)
        n = (math.log(m1) - math.log(m2)) / (math.log(t(one)) - math.log(t(two)))
        scale = _A * m1 / (n * t(one) ** n)
        return n, scale, scale * t(self.lat) ** n

    def numbers(self) -> tuple[float, ...]:
        return (self.unit, self.east, self.north, self.lon, *self.cone())


# State Plane zones of Texas (EPSG codes in US survey feet, and in metres).
_TEXAS = (
    (2275, 32137, Lambert(-101.5, 34.0, (36 + 11 / 60, 34.65), 200_000, 1_000_000)),
    (2276, 32138, Lambert(-98.5, 31 + 2 / 3, (33 + 29 / 30, 32 + 2 / 15), 600_000, 2_000_000)),
    (2277, 32139, Lambert(-(100 + 1 / 3), 29 + 2 / 3, (31 + 53 / 60, 30 + 7 / 60), 700_000, 3_000_000)),
    (2278, 32140, Lambert(-99.0, 27 + 5 / 6, (30 + 17 / 60, 28 + 23 / 60), 600_000, 4_000_000)),
    (2279, 32141, Lambert(-98.5, 25 + 2 / 3, (27 + 5 / 6, 26 + 1 / 6), 300_000, 5_000_000)),
)


@dataclass(frozen=True)
class Transverse:
    """A transverse Mercator system on GRS80; origin in degrees, offsets in metres, scale on the central meridian."""

    lon: float
    lat: float
    scale: float
    east: float
    north: float = 0.0
    unit: float = 1.0

    def start(self) -> float:
        """The rectifying latitude of the origin, in radians (Krueger 1912)."""
        phi = math.radians(self.lat)
        sine = math.sin(phi)
        chi = 2 * math.atan(math.tan(math.pi / 4 + phi / 2) * ((1 - _E * sine) / (1 + _E * sine)) ** (_E / 2)) - math.pi / 2
        return chi + sum(factor * math.sin(2 * step * chi) for step, factor in enumerate(_ALPHA, start=1))

    def numbers(self) -> tuple[float, ...]:
        return self.unit, self.east, self.north, self.lon, self.start(), self.scale * _RECTIFYING


@dataclass(frozen=True)
class Oblique:
    """An oblique Mercator system on GRS80 (Hotine, offsets at the natural origin); centre and azimuth in degrees."""

    lon: float
    lat: float
    azimuth: float
    scale: float
    east: float
    north: float
    unit: float = 1.0

    def constants(self) -> tuple[float, ...]:
        """A, B and H of the projection, the azimuth at the equator, its longitude in degrees and the azimuth (Snyder 1987)."""
        phi, alpha = math.radians(self.lat), math.radians(self.azimuth)
        sine, cosine = math.sin(phi), math.cos(phi)
        b = math.sqrt(1 + _E2 * cosine**4 / (1 - _E2))
        a = _A * b * self.scale * math.sqrt(1 - _E2) / (1 - _E2 * sine * sine)
        t = math.tan(math.pi / 4 - phi / 2) / ((1 - _E * sine) / (1 + _E * sine)) ** (_E / 2)
        d = max(1.0, b * math.sqrt(1 - _E2) / (cosine * math.sqrt(1 - _E2 * sine * sine)))
        f = d + math.copysign(math.sqrt(d * d - 1), phi)
        gamma = math.asin(math.sin(alpha) / d)
        lon = self.lon - math.degrees(math.asin((f - 1 / f) / 2 * math.tan(gamma)) / b)
        return a, b, f * t**b, gamma, lon, alpha

    def numbers(self) -> tuple[float, ...]:
        a, b, h, gamma, lon, azimuth = self.constants()
        return self.unit, self.east, self.north, lon, azimuth, a, b, h, gamma


Zone = Lambert | Transverse | Oblique

# State Plane zones in metres by EPSG code, transverse ones of five states and Alaska's first.
_MERCATOR = {
    26929: Transverse(-(85 + 5 / 6), 30.5, 0.99996, 200_000),
    26930: Transverse(-87.5, 30.0, 1 - 1 / 15_000, 600_000),
    26931: Oblique(-(133 + 2 / 3), 57.0, 323 + 7 / 60 + 48.3685 / 3600, 0.9999, 5_000_000, -5_000_000),
    26958: Transverse(-81.0, 24 + 1 / 3, 1 - 1 / 17_000, 200_000),
    26959: Transverse(-82.0, 24 + 1 / 3, 1 - 1 / 17_000, 200_000),
    26966: Transverse(-(82 + 1 / 6), 30.0, 0.9999, 200_000),
    26967: Transverse(-(84 + 1 / 6), 30.0, 0.9999, 700_000),
    26971: Transverse(-(88 + 1 / 3), 36 + 2 / 3, 0.999975, 300_000),
    26972: Transverse(-(90 + 1 / 6), 36 + 2 / 3, 1 - 1 / 17_000, 700_000),
    26973: Transverse(-(85 + 2 / 3), 37.5, 1 - 1 / 30_000, 100_000, 250_000),
    26974: Transverse(-(87 + 1 / 12), 37.5, 1 - 1 / 30_000, 900_000, 250_000),
}
STATE_PLANE: dict[int, Zone] = {feet: replace(zone, unit=US_FOOT) for feet, _, zone in _TEXAS} | {metres: zone for _, metres, zone in _TEXAS} | _MERCATOR

# EPSG codes of NAD83 UTM zones are 26900 + zone, the system's scale and offset are the same in all.
UTM: dict[int, Zone] = {26900 + zone: Transverse(6.0 * zone - 183, 0.0, 0.9996, 500_000) for zone in range(1, 24)}

# Series from conformal to geodetic latitude (Snyder 1987, eq. 3-5).
_CONFORMAL = (
    _E2 / 2 + 5 * _E2**2 / 24 + _E2**3 / 12 + 13 * _E2**4 / 360,
    7 * _E2**2 / 48 + 29 * _E2**3 / 240 + 811 * _E2**4 / 11520,
    7 * _E2**3 / 120 + 81 * _E2**4 / 1120,
    4279 * _E2**4 / 161280,
)

# Transverse Mercator (Krueger 1912) to the fourth power of the third flattening, back and forth.
_THIRD = _F / (2 - _F)
_RECTIFYING = _A / (1 + _THIRD) * (1 + _THIRD**2 / 4 + _THIRD**4 / 64)
_BETA = (
    _THIRD / 2 - 2 * _THIRD**2 / 3 + 37 * _THIRD**3 / 96 - _THIRD**4 / 360,
    _THIRD**2 / 48 + _THIRD**3 / 15 - 437 * _THIRD**4 / 1440,
    17 * _THIRD**3 / 480 - 37 * _THIRD**4 / 840,
    4397 * _THIRD**4 / 161280,
)
_ALPHA = (
    _THIRD / 2 - 2 * _THIRD**2 / 3 + 5 * _THIRD**3 / 16 + 41 * _THIRD**4 / 180,
    13 * _THIRD**2 / 48 - 3 * _THIRD**3 / 5 + 557 * _THIRD**4 / 1440,
    61 * _THIRD**3 / 240 - 103 * _THIRD**4 / 140,
    49561 * _THIRD**4 / 161280,
)


def geodetic_latitude(conformal: Column) -> Column:
    """Latitude in degrees of a conformal latitude in radians."""
    phi = conformal
    for step, factor in enumerate(_CONFORMAL, start=1):
        phi = phi + factor * F.sin(2 * step * conformal)
    return F.degrees(phi)


def _transverse(xi: Column, eta: Column, lon: Column) -> tuple[Column, Column]:
    """Rectified coordinates of a transverse system to longitude in degrees and conformal latitude in radians."""
    up, right = xi, eta
    for step, factor in enumerate(_BETA, start=1):
        up = up - factor * F.sin(2 * step * xi) * F.cosh(2 * step * eta)
        right = right - factor * F.cos(2 * step * xi) * F.sinh(2 * step * eta)
    return F.degrees(F.atan2(F.sinh(right), F.cos(up))) + lon, F.asin(F.sin(up) / F.cosh(right))


def _conic(right: Column, down: Column, lon: Column, n: Column, scale: Column) -> tuple[Column, Column]:
    """Offsets from the apex of a cone to longitude and conformal latitude, likewise."""
    rho = F.sqrt(right * right + down * down) * F.signum(n)
    theta = F.atan2(right * F.signum(n), down * F.signum(n))
    return F.degrees(theta / n) + lon, F.lit(math.pi / 2) - 2 * F.atan(F.pow(rho / scale, 1 / n))


def _skew(q: Column, along: Column, lon: Column, b: Column, h: Column, gamma: Column) -> tuple[Column, Column]:
    """Skew coordinates of an oblique system, across as an exponential, to longitude and conformal latitude, likewise."""
    s, t, v = (q - 1 / q) / 2, (q + 1 / q) / 2, F.sin(along)
    u = (v * F.cos(gamma) + s * F.sin(gamma)) / t
    turn = F.atan2(s * F.cos(gamma) - v * F.sin(gamma), F.cos(along))
    return lon - F.degrees(turn) / b, F.lit(math.pi / 2) - 2 * F.atan(F.pow(h / F.sqrt((1 + u) / (1 - u)), 1 / b))


def with_survey_lonlat(df: DataFrame, x: str, y: str, code: Column, zones: Mapping[int, Zone]) -> DataFrame:
    """``df`` with ``_survey_lon`` and ``_survey_lat`` in degrees of coordinates in the system that ``code`` names in ``zones``.

    Null for other codes. The constants of all zones are one literal map, and each step is a column of its own, so that
    what it repeats is computed once and many zones make no more code than one.
    """
    table = F.create_map(*[F.lit(v) for key, zone in zones.items() for v in (key, [float(n) for n in zone.numbers()])])
    df = df.withColumn("_zone", F.try_element_at(table, code))
    of = lambda i: F.get("_zone", F.lit(i))
    families = {kind: [key for key, zone in zones.items() if isinstance(zone, kind)] for kind in (Transverse, Lambert, Oblique)}

    def by_family(transverse: Column, conic: Column, skew: Column) -> Column:
        places = zip(families.values(), (transverse, conic, skew), strict=True)
        return F.coalesce(*[F.when(code.isin(keys), place) for keys, place in places if keys], F.lit(None).cast("double"))

    df = df.withColumns({"_right": F.col(x).cast("double") * of(0) - of(1), "_up": F.col(y).cast("double") * of(0) - of(2)})
    right, up = F.col("_right"), F.col("_up")
    across, along = right * F.cos(of(4)) - up * F.sin(of(4)), up * F.cos(of(4)) + right * F.sin(of(4))
    df = df.withColumns({
        "_p": by_family(up / of(5) + of(4), right, F.exp(-of(6) * across / of(5))),
        "_q": by_family(right / of(5), of(6) - up, of(6) * along / of(5)),
    })
    p, q = F.col("_p"), F.col("_q")
    found = [_transverse(p, q, of(3)), _conic(p, q, of(3), of(4), of(5)), _skew(p, q, of(3), of(6), of(7), of(8))]
    df = df.withColumns({"_survey_lon": by_family(*[f[0] for f in found]), "_survey_conformal": by_family(*[f[1] for f in found])})
    df = df.withColumn("_survey_lat", geodetic_latitude(F.col("_survey_conformal")))
    return df.drop("_zone", "_right", "_up", "_p", "_q", "_survey_conformal")


def _wkb_points(wkb: bytes) -> np.ndarray:
    """All coordinates of a WKB geometry as an (n, 2) array."""
    found: list[np.ndarray] = []

    def points(at: int, count: int, order: str, dims: int) -> int:
        block = np.frombuffer(wkb, dtype=f"{order}f8", count=count * dims, offset=at).reshape(count, dims)
        found.append(block[:, :2])
        return at + 8 * dims * count

    def geometry(at: int) -> int:
        order = "<" if wkb[at] == 1 else ">"
        (code,) = struct.unpack_from(f"{order}I", wkb, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        has_z = bool(code & 0x80000000) or (code & 0xFFFF) // 1000 in (1, 3)
        has_m = bool(code & 0x40000000) or (code & 0xFFFF) // 1000 in (2, 3)
        kind, dims = (code & 0xFFFF) % 1000, 2 + has_z + has_m
        if kind == 1:
            return points(at, 1, order, dims)
        (count,) = struct.unpack_from(f"{order}I", wkb, at)
        at += 4
        if kind == 2:
            return points(at, count, order, dims)
        for _ in range(count):
            if kind == 3:
                (ring,) = struct.unpack_from(f"{order}I", wkb, at)
                at = points(at + 4, ring, order, dims)
            else:
                at = geometry(at)
        return at

    geometry(0)
    return np.concatenate(found) if found else np.empty((0, 2))


_BOUNDS = StructType([StructField(n, DoubleType()) for n in ("min_x", "min_y", "max_x", "max_y")])


@F.pandas_udf(_BOUNDS)
def wkb_bounds(geometry: pd.Series) -> pd.DataFrame:
    """Envelope of a WKB geometry; null for a missing or empty one."""
    out = np.full((len(geometry), 4), np.nan)
    for i, wkb in enumerate(geometry):
        points = _wkb_points(wkb) if wkb is not None else ()
        if len(points):
            out[i, :2], out[i, 2:] = points.min(axis=0), points.max(axis=0)
    bounds = pd.DataFrame(out, columns=["min_x", "min_y", "max_x", "max_y"])
    return bounds.astype(object).where(bounds.notna(), None)


def _polygon_rings(wkb: bytes) -> list[np.ndarray]:
    """Rings, in x and y, of a WKB polygon or multipolygon with or without z, m and a reference system."""
    rings: list[np.ndarray] = []

    def geometry(at: int) -> int:
        order = "<" if wkb[at] == 1 else ">"
        (code,) = struct.unpack_from(f"{order}I", wkb, at + 1)
        at += 5 + 4 * bool(code & 0x20000000)
        plain = code & 0x0FFFFFFF
        kind, extra = plain % 1000, plain // 1000
        width = 2 + max(bool(code & 0x80000000) + bool(code & 0x40000000), extra - extra // 2)
        (count,) = struct.unpack_from(f"{order}I", wkb, at)
        at += 4
        for _ in range(count):
            if kind == 3:
                (size,) = struct.unpack_from(f"{order}I", wkb, at)
                rings.append(np.frombuffer(wkb, dtype=f"{order}f8", count=width * size, offset=at + 4).reshape(size, width)[:, :2])
                at += 4 + 8 * width * size
            elif kind == 6:
                at = geometry(at)
            else:
                raise ValueError(f"not a polygon: WKB type {code}")
        return at

    geometry(0)
    return rings


_EDGES = ArrayType(StructType([StructField(n, DoubleType()) for n in ("ax", "ay", "bx", "by")]))


def _area(ring: np.ndarray) -> float:
    """Signed area of a closed ring, positive if it runs anticlockwise; its place does not cost it digits."""
    x, y = (ring - ring[0]).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _inside(x: float, y: float, ring: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    crosses = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[crosses], b[crosses]
    return bool((x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]).sum() % 2)


def _oriented(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings with what they enclose on their left: those in an odd number of others are holes and run clockwise."""
    out = []
    for i, ring in enumerate(rings):
        x, y = (ring[0] + ring[1]) / 2 if len(ring) > 1 else ring[0]
        hole = sum(_inside(x, y, other) for j, other in enumerate(rings) if j != i and len(other) > 3) % 2 == 1
        out.append(ring if (_area(ring) < 0) == hole else ring[::-1])
    return out


@F.pandas_udf(_EDGES)
def polygon_edges(geometry: pd.Series) -> pd.Series:
    """The edges of a WKB polygon, with the polygon on their left, holes included; none for a missing one."""

    def edges(wkb: bytes | None) -> list[tuple[float, ...]]:
        rings = [] if wkb is None else [r.astype(float) for r in _polygon_rings(wkb)]
        parts = [np.hstack([r[:-1], r[1:]]) for r in _oriented(rings) if len(r) > 1]
        return [tuple(e) for e in np.concatenate(parts).tolist()] if parts else []

    return pd.Series([edges(g) for g in geometry])
