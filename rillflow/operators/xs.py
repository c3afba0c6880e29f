"""Channel cross-sections: selection, derived geometry and representative sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.sections import channel_between, channel_shape
from rillflow.functions.text import columns_of, number_list, point_list
from rillflow.plans.ranking import with_rank


def xs_by_flowpath(xs: DataFrame, identifier: str) -> DataFrame:
    """Cross-sections of one flowpath."""
    return xs.where(F.col("flowpath_id") == identifier)


def xs_within_bbox(xs: DataFrame, min_lat: float, min_lon: float, max_lat: float, max_lon: float) -> DataFrame:
    """Cross-sections wholly inside a box; four range predicates that reach the scan."""
    if max_lat <= min_lat or max_lon <= min_lon:
        raise ValueError("the box's maximum latitude and longitude must exceed its minimum")
    return xs.where(
        (F.col("min_y") >= min_lat)
        & (F.col("min_x") >= min_lon)
        & (F.col("max_y") <= max_lat)
        & (F.col("max_x") <= max_lon)
    )


def xs_by_domain(xs: DataFrame, domain: str) -> DataFrame:
    """Cross-sections of one model domain."""
    return xs.where(F.col("domain") == domain)


def subset_xs(xs: DataFrame, identifier: str | None = None, bbox: tuple | None = None) -> DataFrame:
    """By flowpath or by box ``(min_lat, min_lon, max_lat, max_lon)``; one of them must be given."""
    if identifier:
        return xs_by_flowpath(xs, identifier)
    if bbox:
        return xs_within_bbox(xs, *bbox)
    raise ValueError("give an identifier or a bounding box to subset cross-sections")


def reference_for_xs(xs: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference rows of the flowpaths that have a cross-section."""
    return reference.join(xs.select("flowpath_id"), "flowpath_id", "left_semi").select(*columns_of(reference))


def extents(xs: DataFrame, each: list[str] | None = None) -> DataFrame:
    """``(*each, min_x, min_y, max_x, max_y)``: the envelope of all sections, or of those of each group."""
    bounds = [f(c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))]
    return xs.groupBy(*(each or [])).agg(*bounds)


def reference_in_extent(xs: DataFrame, reference: DataFrame, each: list[str] | None = None) -> DataFrame:
    """``(*each, reference columns)``: reference flowpaths whose envelope meets that of the sections.

    Without ``each`` there is one envelope, of all sections. With it there is one for each group, and a flowpath comes
    with every group that it meets. Envelopes that only touch meet; sections and flowpaths without one meet nothing.
    """
    met = meeting_rectangles(extents(xs, each), reference, each or [])
    return met.select(*[F.col(f"`{c}`") for c in (each or [])], *columns_of(reference))


_BOUNDS = ("min_x", "min_y", "max_x", "max_y")


def meeting_rectangles(few: DataFrame, many: DataFrame, names: list[str]) -> DataFrame:
    """Pairs of the rectangles of two frames that meet: ``names`` of the first, all columns of the second.

    A rectangle's level is the power of two that its longer side fits into, so at its level it lies in four tiles at the
    most. Each is filed under the tiles of its own level and of the larger ones that the other frame has, and a pair meets
    by equal tiles at the larger of their two levels, in the tile of the lower left corner of what they share: once.
    """
    bounds = [F.col(c).alias(f"_{c}") for c in _BOUNDS]
    left = few.where(" and ".join(f"{c} is not null" for c in _BOUNDS)).select(*[F.col(f"`{c}`") for c in names], *bounds)
    left = left.withColumn("_level", _level("_"))
    right = many.where(" and ".join(f"{c} is not null" for c in _BOUNDS)).withColumn("_level", _level(""))
    # for each level in use, the larger ones of the other frame: a few dozen rows
    levels = [frame.select("_level").distinct() for frame in (left, right)]
    upward = [_larger(levels[0], levels[1]), _larger(levels[1], levels[0])]

    def filed(frame: DataFrame, larger: DataFrame, prefix: str, home: str) -> DataFrame:
        known = frame.join(larger, "_level")
        own = known.withColumn("_at", F.explode(F.array_union(F.array("_level"), "_levels")))
        own = own.withColumn(home, F.col("_at") == F.col("_level")).drop("_levels", "_level")
        for tile, low, high in (("_tx", "min_x", "max_x"), ("_ty", "min_y", "max_y")):
            own = own.withColumn(tile, F.explode(F.sequence(_tile(f"{prefix}{low}"), _tile(f"{prefix}{high}"))))
        return own

    pairs = filed(left, upward[0], "_", "_home1").join(filed(right, upward[1], "", "_home2"), ["_at", "_tx", "_ty"])
    meet = (F.col("max_x") >= F.col("_min_x")) & (F.col("min_x") <= F.col("_max_x")) & (F.col("max_y") >= F.col("_min_y")) & (F.col("min_y") <= F.col("_max_y"))
    corner = (_tile(F.greatest("min_x", "_min_x")) == F.col("_tx")) & (_tile(F.greatest("min_y", "_min_y")) == F.col("_ty"))
    return pairs.where((F.col("_home1") | F.col("_home2")) & meet & corner)


def _larger(own: DataFrame, other: DataFrame) -> DataFrame:
    """``(_level, _levels)``: for each level of ``own`` the larger ones of ``other``, gathered from the top down."""
    both = own.withColumn("_mine", F.lit(True)).unionByName(other.withColumn("_mine", F.lit(False)))
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("_level")).rangeBetween(Window.unboundedPreceding, -1)
    gathered = both.withColumn("_levels", F.collect_set(F.when(~F.col("_mine"), F.col("_level"))).over(above))
    return gathered.where("_mine").select("_level", "_levels")


def _level(prefix: str) -> Column:
    x, y = (F.col(f"{prefix}max_{c}") - F.col(f"{prefix}min_{c}") for c in "xy")
    return F.ceil(F.log2(F.greatest(x, y, F.lit(1e-9)).cast("double"))).cast("int")


def _tile(value: Column | str) -> Column:
    return F.floor((F.col(value) if isinstance(value, str) else value) / F.pow(F.lit(2.0), F.col("_at"))).cast("bigint")


def _channel() -> Column:
    return channel_between(F.col("points"), F.get("banks", F.lit(0)), F.get("banks", F.lit(1)))


def channel_points(transects: DataFrame) -> DataFrame:
    """Add ``channel``: the points between the banks, elevations cleaned, as an array of ``(x, Y)``."""
    return transects.withColumn("channel", _channel())


def parse_transects(transects: DataFrame) -> DataFrame:
    """Add ``points`` and ``banks`` from the text columns of a survey."""
    return transects.withColumn("points", point_list(F.col("station_elevation_points"))).withColumn(
        "banks", number_list(F.col("bank_stations"))
    )


def channel_metrics(transects: DataFrame) -> DataFrame:
    """Depth ``Ym``, top width ``TW``, area ``A`` and shape ``r`` of each transect that holds a channel.

    A channel needs three points between the banks and 0.25 of relief. ``r = A / (Ym * TW - A)`` is infinite for a
    rectangle. All of it is one expression per row; transects without a channel explode to nothing, which keeps the
    condition from being pushed down and the geometry from being computed twice.
    """
    shapes = F.filter(F.array(channel_shape(_channel())), lambda s: (s["n"] > 2) & (s["Ym"] >= 0.25))
    measured = transects.withColumn("_shape", F.explode(shapes))
    return measured.select(*columns_of(transects), *[F.col(f"_shape.{c}").alias(c) for c in ("Ym", "TW", "A", "r")])


def middle_row(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The row at position ceil(n/2) of each group, for groups of any size."""
    ranked = with_rank(df, group, [F.col(c) for c in order])
    return ranked.where(F.col("rank") == F.ceil(F.col("group_rows") / 2)).drop("rank", "group_rows")


def representative_xs(xs: DataFrame, carried: list[str], tie_break: list[str] | None = None) -> DataFrame:
    """One cross-section per flowpath: mean finite ``r``, mean ``TW`` and ``Ym``, and the middle section's columns.

    Sections are ordered by river station; ``tie_break`` columns make equal stations deterministic.
    """
    known = xs.where(F.col("flowpath_id").isNotNull())
    finite = (F.abs("r") < float("inf")) & ~F.isnan("r")
    means = known.groupBy("flowpath_id").agg(
        F.avg(F.when(finite, F.col("r"))).alias("r"), F.avg("TW").alias("TW"), F.avg("Ym").alias("Y")
    )
    needed = list(dict.fromkeys(["flowpath_id", "river_station", *(tie_break or []), *carried]))
    middle = middle_row(known.select(*needed), ["flowpath_id"], ["river_station", *(tie_break or [])])
    return means.join(middle.select("flowpath_id", "river_station", *carried), "flowpath_id")


def attribute_join(xs: DataFrame, attributes: DataFrame) -> DataFrame:
    """Add stream attributes by common id, which is a number there and text here."""
    keyed = attributes.withColumn("flowpath_id", F.col("comid").cast("bigint").cast("string")).drop("comid")
    return xs.join(keyed, "flowpath_id", "left")


def metadata_join(xs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add the units and the coordinate system of the submodel a section came from."""
    columns = ["flowpath_id", "metdata_units", "epsg", "crs_units"]
    return xs.drop("metdata_units", "epsg", "crs_units").join(metadata.select(*columns), "flowpath_id", "left")
