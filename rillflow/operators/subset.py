"""Basin subsets: everything upstream of an origin, or one VPU, in all related layers.

Every function takes any number of basins at once. A basin is a value in the ``basin`` column (usually the gauge), so
the result of one call serves a whole region and each layer is read once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.text import columns_of, id_text, quoted
from rillflow.operators.origins import origin_rows, vpu_scope_column
from rillflow.plans.frames import Frames, by_shuffle
from rillflow.plans.graph import RiverGraph, trace_upstream
from rillflow.plans.workspace import materialize
from rillflow.schemas import CORE_LAYERS, OPTIONAL_LAYERS

Layers = Mapping[str, DataFrame]


def semi_in(df: DataFrame, column: str, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows whose column is among the ids."""
    return df.join(by_shuffle(ids.select(F.col(id_column).alias(column))), column, "left_semi").select(*columns_of(df))


def semi_or(df: DataFrame, first: str, second: str, ids: DataFrame) -> DataFrame:
    """Rows with either column among the ids, each row once.

    An OR inside one join condition cannot be hashed and would compare every pair, so each column gets an equi-join
    against the distinct ids.
    """
    known = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    hits = df
    for flag, column in (("_hit1", first), ("_hit2", second)):
        mark = known.select(F.col("_id").alias(f"{flag}_id"), F.lit(True).alias(flag))
        hits = hits.join(by_shuffle(mark), F.col(column) == F.col(f"{flag}_id"), "left")
    return hits.where(F.col("_hit1") | F.col("_hit2")).select(*columns_of(df))


def union_ids(*frames: DataFrame) -> DataFrame:
    """Set union of id frames."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.union(frame)
    return merged.distinct()


def subset_ids(graph: RiverGraph, origins: DataFrame) -> DataFrame:
    """``(basin, id)``: each origin, all above it and, unless it is a headwater, the nexus it drains to.

    ``origins`` holds ``(basin, id, toid)``. Origins outside the graph keep their own id only.
    """
    starts = origins.select("basin", F.col("id").alias("origin"), "toid")
    traced = trace_upstream(graph, starts.select("basin", "origin").distinct())
    upstream = traced.select("basin", "id")
    itself = starts.select("basin", F.col("origin").alias("id"))
    drained = by_shuffle(graph.edges.select(F.col("dst").alias("origin")))
    outlet = starts.join(drained, "origin", "left_semi").select("basin", F.col("toid").alias("id"))
    return union_ids(upstream, itself, outlet).where(F.col("id").isNotNull())


def basin_scopes(origins: DataFrame) -> DataFrame:
    """``(basin, vpus)``: the VPUs of all origins of a basin and those they may reach into."""
    scope = origins.select("basin", F.explode(vpu_scope_column(F.col("vpuid"))).alias("vpu"))
    return scope.groupBy("basin").agg(F.array_sort(F.collect_set("vpu")).alias("vpus"))


def scoped_ids(graph: RiverGraph, origins: DataFrame) -> DataFrame:
    """``(basin, id, vpus)``: the ids of every basin with the VPUs it may reach into."""
    return subset_ids(graph, origins).join(by_shuffle(basin_scopes(origins)), "basin")


def _in_basins(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """``(basin, vpus, ...row)`` for rows whose key is among a basin's ids and whose VPU is in its scope."""
    if "basin" in df.columns:
        raise ValueError("a layer must not have a basin column")
    wanted = ids.where(quoted(id_column).isNotNull()).select("basin", "vpus", quoted(id_column).alias(key))
    if id_column != "id":
        wanted = wanted.distinct()
    in_scope = F.array_contains("vpus", F.col("vpuid"))
    return df.join(by_shuffle(wanted), key).where(in_scope).select("basin", "vpus", *columns_of(df))


def subset_layers(layers: Layers, ids: DataFrame, names: list[str] | None = None) -> Frames:
    """The rows of each layer that belong to each basin, keyed by layer name; core layers always included.

    ``ids`` is ``(basin, id, vpus)``, each pair once. Network rows are kept if their id *or* the id they drain to is
    in the basin; the network rows kept then decide divides and lakes, the flowpaths kept decide nexus points. All
    frames are lazy, and a layer that is not used costs nothing.
    """
    names = [*CORE_LAYERS, *[n for n in (names or []) if n not in CORE_LAYERS]]
    unknown = set(names) - set(CORE_LAYERS) - set(OPTIONAL_LAYERS)
    if unknown:
        raise ValueError(f"unknown layers: {', '.join(sorted(unknown))}")

    def kept_network() -> DataFrame:
        network = layers["network"]
        by_id = _in_basins(network, "id", ids, "id")
        by_target = ids.select("basin", "vpus", F.col("id").alias("toid"))
        by_target = network.join(by_shuffle(by_target), "toid").where(F.array_contains("vpus", F.col("vpuid")))
        by_target = by_target.join(by_shuffle(ids.select("basin", "id")), ["basin", "id"], "left_anti")
        return by_id.unionByName(by_target)

    def with_id(name: str) -> DataFrame:
        return _in_basins(layers[name], "id", ids, "id")

    def through_network(name: str, key: str) -> DataFrame:
        return _in_basins(layers[name], key, base["network"], key)

    base = Frames({"network": kept_network, "flowpaths": lambda: with_id("flowpaths")})
    makers = {
        "network": lambda: _with_id_text(base["network"]),
        "flowpaths": lambda: base["flowpaths"],
        "nexus": lambda: _with_id_text(_in_basins(layers["nexus"], "id", base["flowpaths"], "toid")),
        "divides": lambda: through_network("divides", "divide_id"),
        "lakes": lambda: through_network("lakes", "hf_id"),
        "divide-attributes": lambda: through_network("divide-attributes", "divide_id"),
        "flowpath-attributes": lambda: with_id("flowpath-attributes"),
        "flowpath-attributes-ml": lambda: with_id("flowpath-attributes-ml"),
        "pois": lambda: with_id("pois"),
        "hydrolocations": lambda: with_id("hydrolocations"),
    }
    return Frames({name: makers[name] for name in names}).each(lambda frame: frame.drop("vpus"))


def _with_id_text(df: DataFrame) -> DataFrame:
    return df.withColumn("poi_id", id_text(F.col("poi_id")))


def require_rows(subset: Frames) -> Frames:
    """Fail if the core of a subset is empty, naming the layer."""
    for name in ("network", "flowpaths", "nexus", "divides"):
        if name in subset and subset[name].isEmpty():
            raise ValueError(f"No {name} found")
    return subset


def subset_hydrofabric(
    layers: Layers,
    graph: RiverGraph,
    identifiers: list | DataFrame | None,
    id_type: str = "hl_uri",
    names: list[str] | None = None,
    strict: bool = False,
) -> Frames:
    """All layers upstream of each identifier; ``basin`` holds the identifier.

    The basin ids are written once, because every layer joins them.

    ``strict`` runs the checks of a single-basin request: an unknown identifier or an empty core layer raises.
    """
    rows = origin_rows(layers["network"], id_type, identifiers)
    origins = rows.select(F.col("identifier").cast("string").alias("basin"), "id", "toid", "vpuid")
    if strict and origins.isEmpty():
        raise ValueError(f"No origin found for {id_type} in {identifiers}")
    ids = materialize(scoped_ids(graph, origins), "basin-ids")
    if isinstance(identifiers, list):
        # A static filter prunes the folders of layers written by VPU. VPUs are a fixed division of a continent, a few
        # dozen at most.
        vpus = [r.vpu for r in ids.select(F.explode("vpus").alias("vpu")).distinct().collect()]
        near = Frames({name: (lambda name=name: layers[name].where(F.col("vpuid").isin(vpus))) for name in layers})
        subset = subset_layers(near, ids, names)
    else:
        subset = subset_layers(layers, ids, names)
    return require_rows(subset) if strict else subset


def subset_vpu(layers: Layers, vpuid: str, names: list[str] | None = None, strict: bool = False) -> Frames:
    """All layers of one VPU, which is not widened; lakes and divide attributes go through the network rows."""
    names = [*CORE_LAYERS, *[n for n in (names or []) if n not in CORE_LAYERS]]

    def rows(name: str) -> DataFrame:
        return layers[name].where(F.col("vpuid") == vpuid)

    def through_network(name: str, key: str) -> DataFrame:
        return semi_in(rows(name), key, rows("network").where(F.col(key).isNotNull()), key)

    special = {
        "network": lambda: _with_id_text(rows("network")),
        "nexus": lambda: _with_id_text(rows("nexus")),
        "lakes": lambda: through_network("lakes", "hf_id"),
        "divide-attributes": lambda: through_network("divide-attributes", "divide_id"),
    }
    found = Frames({name: special.get(name, lambda name=name: rows(name)) for name in names})
    return require_rows(found) if strict else found


def basin_summary(subset: Mapping[str, DataFrame]) -> DataFrame:
    """Per basin: catchments, their total area, and how many distinct hydrolocation URIs lie in it."""
    catchments = (
        subset["divides"]
        .groupBy("basin")
        .agg(F.count(F.lit(1)).alias("catchments"), F.sum("areasqkm").alias("areasqkm"))
    )
    places = basin_hydrolocations(subset).groupBy("basin").agg(F.count(F.lit(1)).alias("hydrolocations"))
    return catchments.join(by_shuffle(places), "basin", "left").select(
        "basin", "catchments", "areasqkm", F.coalesce("hydrolocations", F.lit(0).cast("bigint")).alias("hydrolocations")
    )


def basin_hydrolocations(subset: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct ``(basin, hl_uri)``, one row per URI so that a continental basin stays distributed."""
    return subset["hydrolocations"].where(F.col("hl_uri").isNotNull()).select("basin", "hl_uri").distinct()


#: What check_relationships looks for: the name, the kind of key, the layer and column that must be in the other's.
REFERENCES = (
    ("flowpaths.id in network", "flowpath", ("flowpaths", "id"), ("network", "id")),
    ("network flowpath in flowpaths", "flowpath", ("network", "flowpath"), ("flowpaths", "id")),
    ("flowpaths.toid in nexus", "nexus", ("flowpaths", "toid"), ("nexus", "id")),
    ("flowpaths.divide_id in divides", "divide", ("flowpaths", "divide_id"), ("divides", "divide_id")),
    ("divides.divide_id in network", "divide", ("divides", "divide_id"), ("network", "divide_id")),
    ("divide-attributes in divides", "divide", ("divide-attributes", "divide_id"), ("divides", "divide_id")),
    ("pois in network", "poi", ("pois", "poi_id"), ("network", "poi_id")),
)


def check_relationships(layers: Mapping[str, DataFrame]) -> DataFrame:
    """``(check, violations)`` for the references between the layers of a subset or a whole domain.

    Every key of every layer is a row ``(kind, key, bit)``; one grouping by key tells which layers have it, and a
    reference is broken by each key with the bit of the one layer and without that of the other.
    """
    checks = [c for c in REFERENCES if c[2][0] in layers and c[3][0] in layers]
    sides = list(dict.fromkeys((kind, *side) for _, kind, *both in checks for side in both))
    bits = {side: 1 << i for i, side in enumerate([*sides, ("vpu", "network", "vpuid")])}

    def text(layer: str, column: str) -> Column:
        if column == "flowpath":
            return F.when(F.col("id").startswith("wb-"), F.col("id"))
        return F.col(column).cast("double").cast("string") if column == "poi_id" else F.col(column).cast("string")

    rows = None
    for layer in dict.fromkeys(side[1] for side in bits):
        keys = [F.struct(F.lit(kind).alias("kind"), text(of, c).alias("key"), F.lit(bit).alias("bit")) for (kind, of, c), bit in bits.items() if of == layer]
        part = layers[layer].select(F.explode(F.array(*keys)).alias("k")).select("k.*").where("key is not null")
        rows = part if rows is None else rows.unionAll(part)
    seen = rows.groupBy("kind", "key").agg(F.bit_or("bit").alias("bits"))

    def has(kind: str, side: tuple[str, str]) -> Column:
        return F.col("bits").bitwiseAND(F.lit(bits[kind, *side])) != 0

    broken = [F.count_if((F.col("kind") == kind) & has(kind, child) & ~has(kind, parent)).alias(name) for name, kind, child, parent in checks]
    vpus = F.greatest(F.count_if(F.col("kind") == "vpu") - 1, F.lit(0)).alias("single VPU")
    counts = seen.agg(*broken, vpus)
    each = [F.struct(F.lit(name).alias("check"), quoted(name).alias("violations")) for name in counts.columns]
    return counts.select(F.explode(F.array(*each)).alias("c")).select("c.*")
