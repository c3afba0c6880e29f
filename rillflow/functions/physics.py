"""Unit conversions and physical formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A mean soil temperature of 45 degrees Fahrenheit, in Kelvin.
MEAN_SOIL_TEMPERATURE = (45 - 32) * 5 / 9 + 273.15

# International Standard Atmosphere (ISO 2533).
_SEA_PRESSURE = 101325.0
_SEA_TEMPERATURE = 288.15
_LAPSE = 0.0065
_EARTH_RADIUS = 6356766.0
_PRESSURE_EXPONENT = 9.80665 / (_LAPSE * 287.05287)

# Albedo by land cover.
LANDCOVER_ALBEDO = {"snow": 0.75, "ice": 0.3, "other": 0.2}


def cm_to_m(value: Column) -> Column:
    return value * 0.01


def km_to_whole_m(value: Column) -> Column:
    """Kilometres to metres, rounded half to even."""
    return F.bround(value * 1000, 0)


def standard_pressure(elevation: Column) -> Column:
    """Pressure in Pa at a height in m of the standard atmosphere's lowest layer, to four decimals."""
    height = _EARTH_RADIUS * elevation / (_EARTH_RADIUS + elevation)
    return F.bround(_SEA_PRESSURE * F.pow(1 - _LAPSE * height / _SEA_TEMPERATURE, F.lit(_PRESSURE_EXPONENT)), 4)


def landcover_albedo(landcover: Column) -> Column:
    """Albedo of snow, ice or other land cover; any other word fails the query."""
    known = F.create_map(*[F.lit(x) for pair in LANDCOVER_ALBEDO.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown land cover: "), landcover)).cast("double")
    return F.coalesce(F.try_element_at(known, landcover), F.when(landcover.isNotNull(), unknown))


def surface_type(vegetation: Column) -> Column:
    """2 (water) for vegetation class 16, else 1 (soil)."""
    return F.when(vegetation == 16, 2).otherwise(1)
