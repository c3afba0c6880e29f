"""Sums over basins that never list what is in a basin.

The river graph numbers flowpaths so that a basin is a range of numbers (a few, if it has several origins). A sum over a
basin is then the difference of two running totals, and any number of nested basins costs a row for each end of a range
besides the rows that are summed. Rows that a number alone does not place, such as a catchment that several flowpaths
share or a neighbour that drains to a basin's outlet, are few and are paired with their basins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators.subset import Layers, basin_scopes
from rillflow.plans.frames import by_shuffle
from rillflow.plans.graph import RiverGraph, within
from rillflow.plans.ranking import running
from rillflow.plans.workspace import materialize

#: Areas are summed in whole billionths, so that a difference of two large totals loses nothing.
AREA = "decimal(38,9)"


def basin_ranges(graph: RiverGraph, origins: DataFrame) -> DataFrame:
    """``(basin, first, last)``: the numbers upstream of each basin's origins ``(basin, id)``, as ranges apart from each other.

    Ranges of a forest are nested or apart, so one that begins inside an earlier one of its basin also ends there.
    """
    ranges = origins.select("basin", "id").distinct().join(by_shuffle(graph.labels), "id").select("basin", "first", "last")
    earlier = Window.partitionBy("basin").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    reach = ranges.withColumn("_reach", F.max("last").over(earlier))
    return reach.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("first"))).drop("_reach")


def range_sums(ranges: DataFrame, points: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """The sums of ``values`` of the points (column ``at``) between ``first`` and ``last`` of each range, by ``basin``.

    ``group`` columns, never null, have to be equal. Points and ends of ranges are sorted together once, and an end's
    running total is what lies before it.
    """
    ends = ranges.select(*group, F.explode(F.array(F.col("first"), F.col("last") + 1)).alias("at")).distinct()
    nothing = [F.lit(None).cast(points.schema[v].dataType).alias(v) for v in values]
    rows = points.select(*group, "at", F.lit(1).alias("kind"), *values).unionAll(ends.select(*group, "at", F.lit(0).alias("kind"), *nothing))
    totals = running(rows, group, ["at", "kind"], {f"sum_{v}": ("sum", v) for v in values}).where("kind = 0")
    totals = materialize(totals.select(*group, "at", *[F.coalesce(f"sum_{v}", F.lit(0)).alias(v) for v in values]), "ends")
    low = totals.withColumnsRenamed({"at": "first", **{v: f"low_{v}" for v in values}})
    high = totals.withColumnsRenamed({"at": "_end", **{v: f"high_{v}" for v in values}})
    found = ranges.withColumn("_end", F.col("last") + 1).join(by_shuffle(low), [*group, "first"]).join(by_shuffle(high), [*group, "_end"])
    return found.groupBy("basin").agg(*[F.sum(F.col(f"high_{v}") - F.col(f"low_{v}")).alias(v) for v in values])


def _loose_keys(graph: RiverGraph, origins: DataFrame) -> DataFrame:
    """``(basin, key)``: ids of a basin that have no number, origins outside the graph and the nexus below an origin."""
    outside = origins.select("basin", "id").join(by_shuffle(graph.labels.select("id")), "id", "left_anti").select("basin", F.col("id").alias("key"))
    drained = graph.edges.select(F.col("dst").alias("id"))
    outlet = origins.join(by_shuffle(drained), "id", "left_semi").select("basin", F.col("toid").alias("key"))
    return outside.unionAll(outlet).where("key is not null").distinct()


def _listed(graph: RiverGraph, ranges: DataFrame, keys: DataFrame, rows: DataFrame, odd: DataFrame, by: list[str], item: str) -> DataFrame:
    """Distinct ``(basin, item, vpuid)`` of rows that one number does not place.

    Those are the rows of ``odd`` items, by the number of any column of ``by``, and all rows with a key of a basin in one
    of these columns whose own number is not in the basin.
    """
    columns = ["basin", item, "vpuid"]
    strange = rows.join(by_shuffle(odd), item, "left_semi")
    found = None
    for column in by:
        numbered = strange.join(by_shuffle(graph.labels.select(F.col("id").alias(column), F.col("first").alias("at"))), column)
        inside = within(ranges, by_shuffle(numbered.select(item, "vpuid", "at")), "at", "first", "last").select(*columns)
        keyed = rows.join(by_shuffle(keys.withColumnRenamed("key", column)), column).select(*columns, "number")
        span = by_shuffle(ranges.select(F.col("basin").alias("_b"), "first", "last"))
        apart = keyed.join(span, (F.col("basin") == F.col("_b")) & F.col("number").between(F.col("first"), F.col("last")), "left_anti")
        both = inside.unionAll(apart.select(*columns))
        found = both if found is None else found.unionAll(both)
    return found.distinct()


def basin_totals(layers: Layers, graph: RiverGraph, origins: DataFrame) -> DataFrame:
    """``(basin, catchments, areasqkm, hydrolocations)`` of every basin with a catchment.

    ``origins`` holds ``(basin, id, toid, vpuid)``. The result is that of ``basin_summary`` over the basins' layers: the
    catchments of the network rows in the basin, their total area, and the distinct hydrolocation URIs, all within the
    VPUs that the basin may reach into. Layers are read once, whatever the basins have in common. A network with a cycle
    has no ranges and is refused.
    """
    if graph.labels is None:
        raise ValueError("the network has a cycle: summarise its basins with basin_summary")
    origins = origins.where("basin is not null")
    ranges = materialize(basin_ranges(graph, origins), "basin-ranges")
    keys = materialize(_loose_keys(graph, origins), "basin-keys")
    scopes = by_shuffle(basin_scopes(origins))
    scope = scopes.select("basin", F.explode("vpus").alias("vpu"))
    numbers = by_shuffle(graph.labels.select("id", F.col("first").alias("number")))

    places = layers["network"].where("divide_id is not null").select("divide_id", "id", "toid", "vpuid").distinct()
    onto = graph.labels.select(F.col("id").alias("toid"), F.lit(True).alias("onto"))
    places = materialize(places.join(numbers, "id", "left").join(by_shuffle(onto), "toid", "left"), "places")
    single = (F.count(F.lit(1)) == 1) & (F.count("number") == 1) & (F.count("onto") == 0)
    kinds = places.groupBy("divide_id").agg(single.alias("plain"), F.min("number").alias("at"), F.min("vpuid").alias("through"))
    kinds = materialize(kinds, "place-kinds")
    divides = layers["divides"].select("divide_id", "vpuid", F.col("areasqkm").cast(AREA).alias("area"))
    plain = kinds.where("plain").join(by_shuffle(divides), "divide_id").where("through is not null and vpuid is not null")
    points = plain.select("through", "vpuid", "at", F.lit(1).cast("bigint").alias("n"), "area", F.col("area").isNotNull().cast("bigint").alias("known"))
    pairs = points.select("through", "vpuid").distinct()
    first = scope.withColumnRenamed("vpu", "through").join(pairs, "through").join(by_shuffle(scope.withColumnRenamed("vpu", "vpuid")), ["basin", "vpuid"])
    cut = ranges.join(by_shuffle(first.select("basin", "through", "vpuid").distinct()), "basin")
    inside = range_sums(cut, points, ["through", "vpuid"], ["n", "area", "known"])

    odd = kinds.where("not plain").select("divide_id")
    listed = _listed(graph, ranges, keys, places, odd, ["id", "toid"], "divide_id")
    in_scope = lambda df: df.join(scopes, "basin").where(F.array_contains("vpus", F.col("vpuid"))).drop("vpus")
    more = in_scope(in_scope(listed).select("basin", "divide_id").distinct().join(by_shuffle(divides), "divide_id"))
    more = more.groupBy("basin").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("area"), F.lit(0)).cast(AREA).alias("area"), F.count("area").alias("known"))
    sums = inside.select("basin", "n", F.col("area").cast(AREA).alias("area"), "known").unionAll(more)
    sums = sums.groupBy("basin").agg(*[F.sum(c).alias(c) for c in ("n", "area", "known")]).where("n > 0")

    uris = layers["hydrolocations"].where("hl_uri is not null").select("hl_uri", "id", "vpuid").distinct()
    uris = materialize(uris.join(numbers, "id", "left"), "uris")
    single = (F.count(F.lit(1)) == 1) & (F.count("number") == 1)
    uri_kinds = materialize(uris.groupBy("hl_uri").agg(single.alias("plain"), F.min("number").alias("at"), F.min("vpuid").alias("vpuid")), "uri-kinds")
    uri_points = uri_kinds.where("plain and vpuid is not null").select("vpuid", "at", F.lit(1).cast("bigint").alias("n"))
    uri_cut = ranges.join(by_shuffle(scope.withColumnRenamed("vpu", "vpuid")), "basin")
    uri_sums = range_sums(uri_cut, uri_points, ["vpuid"], ["n"])
    uri_more = in_scope(_listed(graph, ranges, keys, uris, uri_kinds.where("not plain").select("hl_uri"), ["id"], "hl_uri"))
    uri_more = uri_more.select("basin", "hl_uri").distinct().groupBy("basin").agg(F.count(F.lit(1)).alias("n"))
    places_of = uri_sums.unionAll(uri_more).groupBy("basin").agg(F.sum("n").alias("hydrolocations"))

    out = sums.join(by_shuffle(places_of), "basin", "left")
    return out.select(
        "basin",
        F.col("n").alias("catchments"),
        F.when(F.col("known") > 0, F.col("area").cast("double")).alias("areasqkm"),
        F.coalesce("hydrolocations", F.lit(0).cast("bigint")).alias("hydrolocations"),
    )
