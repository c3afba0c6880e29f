"""Linking model cross-sections to river reaches, and merging the models' sections."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.geo import STATE_PLANE, UTM, Zone, albers_to_lonlat, lonlat_to_albers, with_survey_lonlat
from rillflow.functions.text import columns_of, or_none, river_reach_key
from rillflow.plans.workspace import materialize

KEY = ["model_id", "huc", "river_reach_rs", "thalweg", "xs_max_elevation"]
REACH_IDS = ["us_reach_id", "us_network_to_id", "ds_reach_id", "ds_network_to_id"]


def _marked(df: DataFrame) -> DataFrame:
    """Add a hash of the key. Sorts compare it first, and so seldom reach the texts; equal keys have equal marks."""
    return df.withColumn("_mark", F.xxhash64(*KEY))


def reach_lookup(conflation: DataFrame) -> DataFrame:
    """Key columns to the reach a section is the upstream (``us``) and the downstream (``ds``) end of.

    A section listed by several reaches goes to the one listed last. Both ends are looked up in one table, so the
    sections are joined once.
    """
    return _marked_lookup(conflation).drop("_mark")


def _marked_lookup(conflation: DataFrame) -> DataFrame:
    """``reach_lookup`` with the mark of each key, by which rows are grouped and sorted."""
    ends = conflation.select(
        "model_id",
        "huc",
        F.struct("pos", "reach_id", "network_to_id").alias("listed"),
        F.explode(
            F.array(
                F.struct(F.lit("us").alias("side"), F.col("us_xs").alias("xs")),
                F.struct(F.lit("ds").alias("side"), F.col("ds_xs").alias("xs")),
            )
        ).alias("end"),
    ).where(F.col("end.xs").isNotNull())
    keyed = ends.select(
        "model_id",
        "huc",
        river_reach_key(F.col("end.xs.river"), F.col("end.xs.reach"), F.col("end.xs.xs_id")).alias("river_reach_rs"),
        F.col("end.xs.min_elevation").alias("thalweg"),
        F.col("end.xs.max_elevation").alias("xs_max_elevation"),
        *[F.when(F.col("end.side") == side, F.col("listed")).alias(side) for side in ("us", "ds")],
    )
    last = _marked(keyed).groupBy("_mark", *KEY).agg(F.max("us").alias("us"), F.max("ds").alias("ds"))
    return last.select("_mark", *KEY, *[F.col(c.replace("_", ".", 1)).alias(c) for c in REACH_IDS])


def composite_key_lookup(xs: DataFrame, conflation: DataFrame) -> DataFrame:
    """Add the upstream and downstream reach of each section, ``None`` as text where there is none.

    The elevations are part of the key and compared exactly, as both sides copy them from one model. Sections of a
    (model, HUC) without any conflation are left out: those are listed first, so that the sections are shuffled only once,
    by their key. The parsed conflation is written once, as both joins read it.
    """
    conflation = materialize(conflation.select("model_id", "huc", "pos", "reach_id", "network_to_id", "us_xs", "ds_xs"), "conflation")
    place = ["model_id", "huc"]
    bare = xs.select(*place).distinct().join(conflation.select(*place).distinct(), place, "left_anti")
    covered = xs.where(F.col("model_id").isNotNull() & F.col("huc").isNotNull()).join(materialize(bare, "bare-places"), place, "left_anti")
    linked = _marked(covered).join(_marked_lookup(conflation), ["_mark", *KEY], "left")
    return linked.select(*columns_of(xs), *[or_none(F.col(c)).alias(c) for c in REACH_IDS])


def crs_map(xs: DataFrame) -> DataFrame:
    """Coordinate system of each (HUC, model, river)."""
    code = F.coalesce(F.col("epsg").cast("int").cast("string"), F.lit("None"))
    return xs.select("huc", "model", "river", code.alias("epsg"), "crs_name").distinct()


def crs_family(name):
    """The coordinate family a name belongs to; only NAD83 is known."""
    return F.when(name.contains("NAD83") | name.contains("NAD_1983"), F.lit("EPSG:5070"))


# EPSG codes of geographic NAD83 coordinates and of the common system.
GEOGRAPHIC_NAD83, ALBERS = 4269, 5070


def _projectable(code: Column, zones: Mapping[int, Zone]) -> Column:
    """Whether coordinates of an EPSG code can be projected."""
    return F.coalesce(code.isin(ALBERS, GEOGRAPHIC_NAD83, *UTM, *zones), F.lit(False))


def _set_aside(zones: Mapping[int, Zone]) -> Column:
    """Whether a section has a code that can't be projected and names a system of another family than NAD83."""
    other = F.col("crs_name").isNotNull() & crs_family(F.col("crs_name")).isNull()
    return other & ~_projectable(F.col("epsg").cast("int"), zones)


def unprojected_xs(xs: DataFrame, zones: Mapping[int, Zone] = STATE_PLANE) -> DataFrame:
    """The sections that ``consolidate_xs`` doesn't return: as they are, with a null ``crs``.

    The two have all rows of ``xs``, so its count says how many are not in the common system.
    """
    return xs.where(_set_aside(zones)).withColumn("crs", F.lit(None).cast("string")).select(*columns_of(xs.drop("crs")), "crs")


def consolidate_xs(xs: DataFrame, x: str, y: str, zones: Mapping[int, Zone] = STATE_PLANE) -> DataFrame:
    """All models' sections as one table in EPSG:5070, with ``x`` and ``y`` projected and ``crs`` set.

    Rows say their system in ``epsg``: 5070 itself, geographic NAD83, a NAD83 UTM zone, or a conic, transverse
    or oblique zone of ``zones``, which a caller extends by the zones of its surveys. They are projected by it, whatever ``crs_name`` says. Another
    code, or none, fails the job, as such a section can't be labelled with a system it was not projected to; but if its
    ``crs_name`` is of another family than NAD83, it is one of ``unprojected_xs`` instead. Null coordinates stay null.
    """
    known = xs.where(~_set_aside(zones))
    code, a, b = F.col("epsg").cast("int"), F.col(x).cast("double"), F.col(y).cast("double")
    systems = UTM | dict(zones)
    in_zone = code.isin(*systems)
    known = with_survey_lonlat(known, x, y, code, systems)
    geographic = code == GEOGRAPHIC_NAD83
    known = known.withColumns({"_survey_lon": F.when(geographic, a).otherwise(F.col("_survey_lon")), "_survey_lat": F.when(geographic, b).otherwise(F.col("_survey_lat"))})
    albers = lonlat_to_albers(F.col("_survey_lon"), F.col("_survey_lat"))
    unknown = F.raise_error(F.concat(F.lit("no projection for EPSG code "), F.coalesce(code.cast("string"), F.lit("null")))).cast("double")

    def projected(i: int, same: Column) -> Column:
        return F.when(code == ALBERS, same).when((code == GEOGRAPHIC_NAD83) | in_zone, albers[i]).otherwise(unknown)

    out = known.withColumns({x: projected(0, a), y: projected(1, b), "crs": F.lit(f"EPSG:{ALBERS}")})
    return out.select(*columns_of(xs.drop("crs")), "crs")


def with_lonlat(df: DataFrame, x: str, y: str) -> DataFrame:
    """Add ``lon`` and ``lat`` for EPSG:5070 coordinates."""
    lon, lat = albers_to_lonlat(F.col(x), F.col(y))
    return df.withColumn("lon", lon).withColumn("lat", lat)
