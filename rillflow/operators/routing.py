"""Replace-and-route segments: the reach of one stream order downstream of a point, cut at lakes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.text import columns_of
from rillflow.operators.origins import vpu_scope_column
from rillflow.plans.frames import Frames
from rillflow.plans.graph import within
from rillflow.plans.ranking import running
from rillflow.plans.workspace import materialize
from rillflow.schemas import UPSTREAM_VPUS


def full_outer(mainstem: DataFrame, flowpaths: DataFrame) -> DataFrame:
    """Network rows of a mainstem and flowpaths matched on divide, unmatched rows of both sides kept."""
    return mainstem.join(flowpaths, "divide_id", "full")


def reach_starts(network: DataFrame, flowpaths: DataFrame, reach_ids: list | DataFrame) -> DataFrame:
    """``(reach_id, from_seq, hf_mainstem, start_vpu, vpus, reach_order)`` of each reach: where its segment starts.

    ``vpus`` is the scope of its VPU and ``reach_order`` the stream order of its own flowpath.
    """
    reaches = network.where(F.col("hf_id").isNotNull())
    if isinstance(reach_ids, DataFrame):
        reaches = reaches.join(reach_ids.toDF("hf_id"), "hf_id", "left_semi")
    else:
        reaches = reaches.where(F.col("hf_id").isin([float(r) for r in reach_ids]))
    # The first row of a reach decides; the lowest hydroseq makes "first" the same in every run.
    first = F.min(F.struct(F.col("hydroseq").alias("from_seq"), "hf_mainstem", "vpuid", "divide_id")).alias("start")
    start = reaches.groupBy(F.col("hf_id").cast("bigint").alias("reach_id")).agg(first)
    orders = flowpaths.groupBy("divide_id").agg(F.min("order").alias("reach_order"))
    return start.select(
        "reach_id",
        F.col("start.from_seq").alias("from_seq"),
        F.col("start.hf_mainstem").alias("hf_mainstem"),
        F.col("start.divide_id").alias("divide_id"),
        F.col("start.vpuid").alias("start_vpu"),
        vpu_scope_column(F.col("start.vpuid")).alias("vpus"),
    ).join(orders, "divide_id").drop("divide_id")


def _segment_flowpaths(features: DataFrame, flowpaths: DataFrame) -> DataFrame:
    """``(reach_id, vpus, ...flowpath)``: flowpaths on the rows' divides that have the stream order of the rows."""
    divides = features.select("reach_id", "vpus", "reach_order", "divide_id").distinct()
    kept = (F.col("order") == F.col("reach_order")) & F.array_contains("vpus", F.col("vpuid"))
    return flowpaths.join(divides, "divide_id").where(kept).select("reach_id", "vpus", *columns_of(flowpaths))


def _lakes_on(segment: DataFrame, lakes: DataFrame) -> DataFrame:
    """Lakes at the points of interest of a segment."""
    places = segment.where(F.col("poi_id").isNotNull()).select(
        "reach_id", "vpus", F.col("poi_id").cast("bigint").cast("int").alias("poi_id")
    )
    found = lakes.join(places.distinct(), "poi_id").where(F.array_contains("vpus", F.col("vpuid")))
    return found.select("reach_id", *columns_of(lakes))


def break_at_lakes(features: DataFrame, lakes: DataFrame, lake_rows: DataFrame | None = None) -> DataFrame:
    """Keep a segment's network rows at or above its most upstream lake; segments without lakes are unchanged.

    hydroseq falls going downstream, so the most upstream lake row has the largest ``hf_hydroseq``. ``lake_rows`` are
    the network rows in which lakes are looked up, by default the segment's own. A segment whose lakes match none of
    them keeps nothing.
    """
    at_lakes = lakes.select("reach_id", "hf_id").distinct()
    rows = (features if lake_rows is None else lake_rows).select("reach_id", "hf_id", "hf_hydroseq")
    cut = (
        at_lakes.join(rows, ["reach_id", "hf_id"], "left")
        .groupBy("reach_id")
        .agg(F.max("hf_hydroseq").alias("cut"), F.lit(True).alias("has_lake"))
    )
    above = F.col("has_lake").isNull() | (F.col("hf_hydroseq") >= F.col("cut"))
    return features.join(cut, "reach_id", "left").where(above).select(*columns_of(features))


def _scopes_of(*vpus: str) -> Column:
    """The starting VPUs whose scope holds all of the named VPU columns: their own if they are equal, and a widened one."""
    same = F.lit(True)
    for vpu in vpus[1:]:
        same = same & (F.col(vpu) == F.col(vpus[0]))
    found = [F.when(same & ~F.col(vpus[0]).isin(list(UPSTREAM_VPUS)), F.col(vpus[0]))]
    for start, scope in UPSTREAM_VPUS.items():
        inside = F.lit(True)
        for vpu in vpus:
            inside = inside & F.col(vpu).isin(list(scope))
        found.append(F.when(inside, F.lit(start)))
    return F.filter(F.array(*found), lambda v: v.isNotNull())


#: What a segment is one interval of: a mainstem and a stream order, as seen from a starting VPU.
STEM = ["hf_mainstem", "reach_order", "start_vpu"]


def _stem_rows(network: DataFrame, flowpaths: DataFrame) -> DataFrame:
    """``(*STEM, divide_id, poi_id, hydroseq, hf_hydroseq)``: network rows with the stream orders of their flowpaths.

    ``poi_id`` is the flowpath's, so a row appears once for each flowpath of its divide.
    """
    rows = network.where("divide_id is not null and hydroseq is not null").select("divide_id", "hf_hydroseq", "hydroseq", "hf_mainstem", F.col("vpuid").alias("row_vpu"))
    paths = flowpaths.select("divide_id", F.col("order").alias("reach_order"), F.col("vpuid").alias("path_vpu"), F.col("poi_id").cast("bigint").cast("int").alias("poi_id"))
    both = rows.join(paths, "divide_id").withColumn("start_vpu", F.explode(_scopes_of("row_vpu", "path_vpu")))
    return both.select(*STEM, "divide_id", "poi_id", "hydroseq", "hf_hydroseq")


def _lake_marks(network: DataFrame, rows: DataFrame, lakes: DataFrame) -> DataFrame:
    """``(*STEM, hydroseq, hf_hydroseq)``: what lakes do to a segment from ``hydroseq`` on, going downstream.

    A lake at a point of interest of a stem cuts its segments at the network rows of the lake, as soon as a segment has
    both; where it has the point but no such row yet, ``hf_hydroseq`` is null, and the segment keeps nothing.
    """
    lake = lakes.select("poi_id", F.col("hf_id").alias("lake_hf"), F.col("vpuid").alias("lake_vpu")).where("poi_id is not null").distinct()
    at = rows.where("poi_id is not null").select(*STEM, "poi_id", F.col("hydroseq").alias("lake_seq")).distinct().join(lake, "poi_id")
    at = at.where(F.array_contains(vpu_scope_column(F.col("start_vpu")), F.col("lake_vpu"))).select(*STEM, "lake_seq", "lake_hf").distinct()
    at = materialize(at, "stem-lakes")
    places = network.where("hf_id is not null and hydroseq is not null").select(F.col("hf_id").alias("lake_hf"), "hf_mainstem", F.col("hydroseq").alias("row_seq"), F.col("hf_hydroseq").alias("row_hf"), F.col("vpuid").alias("row_vpu"))
    places = places.withColumn("start_vpu", F.explode(_scopes_of("row_vpu")))
    cuts = at.join(places, ["lake_hf", "hf_mainstem", "start_vpu"])
    cuts = cuts.select(*STEM, F.greatest("lake_seq", "row_seq").alias("hydroseq"), F.col("row_hf").alias("hf_hydroseq"))
    return cuts.unionByName(at.select(*STEM, F.col("lake_seq").alias("hydroseq"), F.lit(None).cast("double").alias("hf_hydroseq")))


def segment_intervals(layers: Mapping[str, DataFrame], reach_ids: list | DataFrame) -> tuple[DataFrame, DataFrame]:
    """The segment below each reach as an interval, and the numbered rows that intervals are of.

    Intervals are ``(reach_id, *STEM, vpus, first_row, last_row, cut)``, rows ``(*STEM, divide_id, hf_hydroseq, row)``,
    numbered from the river's mouth. A segment is the rows of its stem from ``first_row`` to ``last_row`` that are not
    below ``cut``. Going up a stem, the highest lake row so far is a running maximum, and so is the highest row, so each
    reach finds its lake and its first row by its place in the stem, and a stem of n reaches takes a multiple of n rows.
    """
    network, flowpaths, lakes = layers["network"], layers["flowpaths"], layers["lakes"]
    starts = reach_starts(network, flowpaths, reach_ids)
    starts = materialize(starts.where("hf_mainstem is not null and from_seq is not null"), "reach-starts")
    rows = _stem_rows(network, flowpaths)
    marks = _lake_marks(network, rows, lakes)
    rows = rows.drop("poi_id").distinct()

    # up the stem: lake marks, then rows, then the reaches that start there
    kind = lambda n: F.lit(n).alias("kind")
    number = lambda c: F.col(c).cast("double").alias(c)
    no_row = [F.lit(None).cast("string").alias("divide_id"), F.lit(None).cast("bigint").alias("reach_id")]
    events = marks.select(*STEM, number("hydroseq"), kind(0), F.lit(None).cast("double").alias("top"), number("hf_hydroseq").alias("lake"), F.lit(1).cast("bigint").alias("lakes"), F.lit(0).cast("bigint").alias("one"), *no_row)
    events = events.unionByName(rows.select(*STEM, number("hydroseq"), kind(1), number("hf_hydroseq").alias("top"), F.lit(None).cast("double").alias("lake"), F.lit(0).cast("bigint").alias("lakes"), F.lit(1).cast("bigint").alias("one"), "divide_id", F.lit(None).cast("bigint").alias("reach_id")))
    events = events.unionByName(starts.select(*STEM, number("from_seq").alias("hydroseq"), kind(2), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("lake"), F.lit(0).cast("bigint").alias("lakes"), F.lit(0).cast("bigint").alias("one"), F.lit(None).cast("string").alias("divide_id"), "reach_id"))
    up = running(events, STEM, ["hydroseq", "kind"], {"cut": ("max", "lake"), "some": ("sum", "lakes"), "row": ("sum", "one"), "highest": ("max", "top")})
    up = materialize(up, "stems")
    numbered = up.where("kind = 1").select(*STEM, "divide_id", F.col("top").alias("hf_hydroseq"), "row", "highest")
    ends = up.where("kind = 2").select(*STEM, "reach_id", F.col("row").alias("last_row"), "cut", F.col("some") > 0)
    ends = ends.toDF(*STEM, "reach_id", "last_row", "cut", "has_lake").where("last_row > 0 and (not has_lake or cut is not null)")

    # rows that are below the cut, as is every row before them, come before the segment
    below = numbered.select(*STEM, F.col("highest").alias("at"), F.lit(1).cast("bigint").alias("one"), F.lit(None).cast("bigint").alias("reach_id"))
    asked = ends.where("has_lake").select(*STEM, F.col("cut").alias("at"), F.lit(0).cast("bigint").alias("one"), "reach_id")
    skipped = running(below.unionByName(asked), STEM, ["at", "one"], {"skipped": ("sum", "one")}).where("reach_id is not null")
    ends = ends.join(skipped.select(*STEM, "reach_id", "skipped"), [*STEM, "reach_id"], "left")
    first = (F.coalesce("skipped", F.lit(0)) + 1).alias("first_row")
    vpus = vpu_scope_column(F.col("start_vpu")).alias("vpus")
    return ends.select("reach_id", *STEM, vpus, first, "last_row", "cut"), numbered.drop("highest")


def rnr_segment(layers: Mapping[str, DataFrame], reach_ids: list | DataFrame) -> Frames:
    """The layers of the routing segment below each reach, with a ``reach_id`` column.

    Segments are intervals of their stems until a layer asks for their rows; only these are listed, each once.
    """
    flowpaths, lakes = layers["flowpaths"], layers["lakes"]
    intervals, rows = segment_intervals(layers, reach_ids)
    listed = within(intervals, rows, "row", "first_row", "last_row", tuple(STEM))
    listed = listed.where(F.col("cut").isNull() | (F.col("hf_hydroseq") >= F.col("cut")))
    segment = materialize(_segment_flowpaths(listed, flowpaths), "segment")

    def pick(layer: str, key: str, ids: DataFrame, id_column: str) -> DataFrame:
        wanted = ids.where(F.col(id_column).isNotNull()).select("reach_id", F.col(id_column).alias(key)).distinct()
        return layers[layer].join(wanted, key).select("reach_id", *columns_of(layers[layer]))

    def at_places(layer: str) -> DataFrame:
        place = F.col("poi_id").cast("bigint").cast("int")
        return pick(layer, "poi_id", segment.select("reach_id", place.alias("poi_id")), "poi_id")

    ends = segment.select("reach_id", F.explode(F.array("id", "toid")).alias("id"))
    return Frames(
        {
            "flowpaths": lambda: segment.drop("vpus"),
            "nexus": lambda: pick("nexus", "id", segment, "toid"),
            "divides": lambda: pick("divides", "divide_id", segment, "divide_id"),
            "divide-attributes": lambda: pick("divide-attributes", "divide_id", segment, "divide_id"),
            "network": lambda: pick("network", "id", ends, "id"),
            "pois": lambda: at_places("pois"),
            "flowpath-attributes": lambda: pick("flowpath-attributes", "id", segment, "id"),
            "hydrolocations": lambda: at_places("hydrolocations"),
            "lakes": lambda: _lakes_on(segment, lakes),
        }
    )
