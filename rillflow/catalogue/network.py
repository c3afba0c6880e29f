"""Queries on the river network: graph, origins, basins, routing segments, joins and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.catalogue import testdata as td
from rillflow.catalogue.registry import query, rounded
from rillflow.operators import origins as org
from rillflow.operators import routing
from rillflow.operators import subset as sub
from rillflow.operators import totals
from rillflow.plans import graph as gr
from rillflow.plans.frames import by_shuffle
from rillflow.plans.ranking import row_index

_EDGES = """edges AS (SELECT f.id AS src, n.toid AS dst, f.toid AS nexus FROM flowpaths f
  JOIN (SELECT id, min(toid) AS toid FROM network WHERE id NOT LIKE 'wb-%' GROUP BY id) n ON f.toid = n.id
  WHERE n.toid IS NOT NULL)"""

_BASINS = (
    td.ctes(*td.LAYERS, recursive=True)
    + f""",
{_EDGES},
origins AS (SELECT DISTINCT hl_uri AS basin, id, toid, vpuid FROM network WHERE hl_uri IS NOT NULL),
up AS (SELECT basin, id FROM origins UNION SELECT up.basin, e.src FROM up JOIN edges e ON e.dst = up.id),
ids AS (SELECT basin, id FROM up UNION SELECT basin, toid FROM origins WHERE id IN (SELECT dst FROM edges)),
scope AS (SELECT basin, vpuid AS vpu FROM origins
  UNION SELECT basin, unnest(['11', '10U', '10L', '08', '07', '05']) FROM origins WHERE vpuid = '08'),
net AS (SELECT s.basin, n.* FROM network n JOIN scope s ON s.vpu = n.vpuid
  WHERE EXISTS (SELECT 1 FROM ids u WHERE u.basin = s.basin AND u.id = n.id)
     OR EXISTS (SELECT 1 FROM ids u WHERE u.basin = s.basin AND u.id = n.toid)),
fps AS (SELECT u.basin, f.* FROM flowpaths f JOIN ids u ON u.id = f.id
  JOIN scope s ON s.basin = u.basin AND s.vpu = f.vpuid),
divs AS (SELECT s.basin, d.* FROM divides d JOIN scope s ON s.vpu = d.vpuid
  WHERE EXISTS (SELECT 1 FROM net n WHERE n.basin = s.basin AND n.divide_id = d.divide_id)),
attrs AS (SELECT s.basin, d.* FROM divide_attributes d JOIN scope s ON s.vpu = d.vpuid
  WHERE EXISTS (SELECT 1 FROM net n WHERE n.basin = s.basin AND n.divide_id = d.divide_id)),
hls AS (SELECT u.basin, h.* FROM hydrolocations h JOIN ids u ON u.id = h.id
  JOIN scope s ON s.basin = u.basin AND s.vpu = h.vpuid)
"""
)


def basins(spark, sf, names=None):
    """All gauges' basins."""
    return sub.subset_hydrofabric(td.layers(spark, sf), td.graph(spark, sf), None, "hl_uri", names or list(sub.OPTIONAL_LAYERS))


@query(
    "basin_summary",
    _BASINS
    + """SELECT d.basin, d.catchments, round(d.areasqkm, 6) AS areasqkm, coalesce(h.n, 0) AS hydrolocations
FROM (SELECT basin, count(*) AS catchments, sum(areasqkm) AS areasqkm FROM divs GROUP BY basin) d
LEFT JOIN (SELECT basin, count(DISTINCT hl_uri) AS n FROM hls GROUP BY basin) h ON d.basin = h.basin""",
)
def basin_summary(spark, sf):
    """Every gauge's basin, nested ones too, without a row for each catchment of each basin."""
    layers = td.layers(spark, sf)
    rows = org.origin_rows(layers["network"], "hl_uri")
    starts = rows.select(F.col("identifier").alias("basin"), "id", "toid", "vpuid")
    return rounded(totals.basin_totals(layers, td.graph(spark, sf), starts))


@query("basin_hydrolocations", _BASINS + "SELECT DISTINCT basin, hl_uri FROM hls WHERE hl_uri IS NOT NULL")
def basin_hydrolocations(spark, sf):
    return sub.basin_hydrolocations(basins(spark, sf, ["hydrolocations"]))


_LAYER_SQL = {
    "network": "SELECT basin, id, toid, divide_id, CAST(CAST(poi_id AS BIGINT) AS VARCHAR) AS poi_id FROM net",
    "flowpaths": 'SELECT basin, id, toid, hydroseq, "order", areasqkm FROM fps',
    "nexus": """SELECT s.basin, n.id, n.toid, n.type, CAST(CAST(n.poi_id AS BIGINT) AS VARCHAR) AS poi_id
FROM nexus n JOIN scope s ON s.vpu = n.vpuid
WHERE EXISTS (SELECT 1 FROM fps f WHERE f.basin = s.basin AND f.toid = n.id)""",
    "divides": "SELECT basin, divide_id, id, areasqkm FROM divs",
    "lakes": """SELECT s.basin, l.lake_id, l.poi_id, l.hf_id, l.lake_x FROM lakes l JOIN scope s ON s.vpu = l.vpuid
WHERE EXISTS (SELECT 1 FROM net n WHERE n.basin = s.basin AND n.hf_id = l.hf_id)""",
    "divide-attributes": """SELECT basin, divide_id, "mode.ISLTYP", "mean.elevation", "dist_4.twi" FROM attrs""",
    "flowpath-attributes": """SELECT u.basin, a.id, a.gage, a."MusK", a."So" FROM flowpath_attributes a
JOIN ids u ON u.id = a.id JOIN scope s ON s.basin = u.basin AND s.vpu = a.vpuid""",
    "flowpath-attributes-ml": """SELECT u.basin, a.id, a."YCC", a.dingman_r FROM flowpath_attributes_ml a
JOIN ids u ON u.id = a.id JOIN scope s ON s.basin = u.basin AND s.vpu = a.vpuid""",
    "pois": """SELECT u.basin, p.poi_id, p.id, p.nex_id FROM pois p
JOIN ids u ON u.id = p.id JOIN scope s ON s.basin = u.basin AND s.vpu = p.vpuid""",
    "hydrolocations": "SELECT basin, poi_id, id, hl_uri FROM hls",
}

_LAYER_COLUMNS = {
    "network": ["id", "toid", "divide_id", "poi_id"],
    "flowpaths": ["id", "toid", "hydroseq", "order", "areasqkm"],
    "nexus": ["id", "toid", "type", "poi_id"],
    "divides": ["divide_id", "id", "areasqkm"],
    "lakes": ["lake_id", "poi_id", "hf_id", "lake_x"],
    "divide-attributes": ["divide_id", "mode.ISLTYP", "mean.elevation", "dist_4.twi"],
    "flowpath-attributes": ["id", "gage", "MusK", "So"],
    "flowpath-attributes-ml": ["id", "YCC", "dingman_r"],
    "pois": ["poi_id", "id", "nex_id"],
    "hydrolocations": ["poi_id", "id", "hl_uri"],
}


def _layer_query(layer):
    def run(spark, sf):
        frame = basins(spark, sf, [layer])[layer]
        return frame.select("basin", *[F.col(f"`{c}`") for c in _LAYER_COLUMNS[layer]])

    query(f"subset_layers_{layer.replace('-', '_')}", _BASINS + _LAYER_SQL[layer])(run)


for _layer in _LAYER_SQL:
    _layer_query(_layer)


@query(
    "subset_hydrofabric",
    _BASINS
    + """SELECT basin, 'network' AS layer, count(*) AS n FROM net GROUP BY basin
UNION ALL SELECT basin, 'flowpaths', count(*) FROM fps GROUP BY basin
UNION ALL SELECT basin, 'divides', count(*) FROM divs GROUP BY basin
UNION ALL SELECT basin, 'divide-attributes', count(*) FROM attrs GROUP BY basin
UNION ALL SELECT basin, 'hydrolocations', count(*) FROM hls GROUP BY basin""",
)
def subset_hydrofabric(spark, sf):
    found = basins(spark, sf, ["divide-attributes", "hydrolocations"])
    counts = [
        found[layer].groupBy("basin").agg(F.lit(layer).alias("layer"), F.count(F.lit(1)).alias("n"))
        for layer in ("network", "flowpaths", "divides", "divide-attributes", "hydrolocations")
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("subset_ids", _BASINS + "SELECT basin, id FROM ids")
def subset_ids(spark, sf):
    rows = org.origin_rows(td.view(spark, sf, "network"), "hl_uri")
    starts = rows.select(F.col("identifier").alias("basin"), "id", "toid")
    return sub.subset_ids(td.graph(spark, sf), starts)


@query(
    "connectivity_edges",
    td.ctes("flowpaths", "network") + f", {_EDGES} SELECT src, dst, nexus FROM edges",
)
def connectivity_edges(spark, sf):
    return gr.connectivity_edges(td.view(spark, sf, "flowpaths"), td.view(spark, sf, "network"))


@query("connectivity_nodes", td.ctes("flowpaths") + " SELECT id FROM flowpaths UNION SELECT 'wb-0'")
def connectivity_nodes(spark, sf):
    return gr.connectivity_nodes(td.view(spark, sf, "flowpaths"))


@query(
    "upstream_segments",
    td.ctes("flowpaths", "network", recursive=True)
    + f""", {_EDGES},
up AS (SELECT DISTINCT dst AS origin, dst AS id FROM edges WHERE dst IN (SELECT id FROM flowpaths)
  UNION SELECT up.origin, e.src FROM up JOIN edges e ON e.dst = up.id)
SELECT origin, id FROM up""",
)
def upstream_segments(spark, sf):
    """Every flowpath as an origin."""
    origins = td.view(spark, sf, "flowpaths").select(F.col("id").alias("origin"))
    return gr.upstream_segments(td.graph(spark, sf), origins)


@query(
    "upstream_segments_deep_chain",
    """SELECT 'wb-0' AS origin, 'wb-' || (c_custkey + 1) AS id FROM customer UNION SELECT 'wb-0', 'wb-0'""",
)
def upstream_segments_deep_chain(spark, sf):
    """Everything above each outlet of a network as deep as it is long."""
    graph = td.graph(spark, sf, "chain")
    outlets = graph.nodes.join(by_shuffle(graph.edges.select(F.col("src").alias("id"))), "id", "left_anti")
    return gr.upstream_segments(graph, outlets.select(F.col("id").alias("origin")))


@query(
    "upstream_adjacency",
    td.ctes("flowpaths", "network")
    + f", {_EDGES} SELECT dst AS id, count(*) OVER (PARTITION BY dst) AS n_upstream, src AS upstream FROM edges",
)
def upstream_adjacency(spark, sf):
    return gr.upstream_adjacency(td.graph(spark, sf).edges)


@query(
    "find_origin",
    td.ctes("network")
    + """SELECT hl_uri AS identifier, id, toid, vpuid, hydroseq, poi_id, hl_uri, false AS ambiguous
FROM network WHERE hl_uri IS NOT NULL""",
)
def find_origin(spark, sf):
    network = td.view(spark, sf, "network")
    return org.resolve_origins(org.origin_rows(network, "hl_uri"))


@query(
    "find_origin_by_poi",
    td.ctes("network")
    + """, c AS (SELECT DISTINCT poi_id AS identifier, hydroseq, id FROM network WHERE poi_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY hydroseq NULLS FIRST, id) AS rn FROM c)
SELECT identifier, id, hydroseq FROM r WHERE rn = 1""",
)
def find_origin_by_poi(spark, sf):
    network = td.view(spark, sf, "network")
    return org.resolve_origins(org.origin_rows(network, "poi_id")).select("identifier", "id", "hydroseq")


@query(
    "min_hydroseq",
    td.ctes("network")
    + """SELECT hf_mainstem, min(hydroseq) AS hydroseq, arg_min(id, hydroseq) AS id FROM network
WHERE hf_mainstem IS NOT NULL GROUP BY hf_mainstem""",
)
def min_hydroseq(spark, sf):
    return org.min_hydroseq(td.view(spark, sf, "network"), "hf_mainstem")


@query("gages_in_domain", td.ctes("network") + "SELECT DISTINCT hl_uri FROM network WHERE hl_uri LIKE 'gages-%'")
def gages_in_domain(spark, sf):
    return org.gages_in_domain(td.view(spark, sf, "network"))


@query(
    "vpu_filter",
    td.ctes("flowpaths")
    + "SELECT id, vpuid FROM flowpaths WHERE vpuid IN ('11', '10U', '10L', '08', '07', '05')",
)
def vpu_filter(spark, sf):
    return org.vpu_filter(td.view(spark, sf, "flowpaths"), "08").select("id", "vpuid")


@query(
    "predicates",
    td.ctes("network")
    + """SELECT id, hydroseq FROM network
WHERE type = 'network' AND vpuid IN ('01', '08') AND hydroseq >= 10 AND hydroseq <= 1000""",
)
def predicates(spark, sf):
    network = td.view(spark, sf, "network")
    return network.where(
        (F.col("type") == "network") & F.col("vpuid").isin("01", "08") & F.col("hydroseq").between(10, 1000)
    ).select("id", "hydroseq")


@query(
    "subset_vpu",
    td.ctes(*td.LAYERS)
    + """, net AS (SELECT * FROM network WHERE vpuid = '08')
SELECT 'network' AS layer, id AS item FROM net
UNION ALL SELECT 'flowpaths', id FROM flowpaths WHERE vpuid = '08'
UNION ALL SELECT 'nexus', id FROM nexus WHERE vpuid = '08'
UNION ALL SELECT 'divides', divide_id FROM divides WHERE vpuid = '08'
UNION ALL SELECT 'lakes', res_id FROM lakes WHERE vpuid = '08' AND hf_id IN (SELECT hf_id FROM net)
UNION ALL SELECT 'divide-attributes', divide_id FROM divide_attributes
  WHERE vpuid = '08' AND divide_id IN (SELECT divide_id FROM net WHERE divide_id IS NOT NULL)
UNION ALL SELECT 'flowpath-attributes', id FROM flowpath_attributes WHERE vpuid = '08'
UNION ALL SELECT 'flowpath-attributes-ml', id FROM flowpath_attributes_ml WHERE vpuid = '08'
UNION ALL SELECT 'pois', id FROM pois WHERE vpuid = '08'
UNION ALL SELECT 'hydrolocations', id FROM hydrolocations WHERE vpuid = '08'""",
)
def subset_vpu(spark, sf):
    found = sub.subset_vpu(td.layers(spark, sf), "08", list(sub.OPTIONAL_LAYERS))
    item = {"divides": "divide_id", "divide-attributes": "divide_id", "lakes": "res_id"}
    out = None
    for layer, frame in found.items():
        rows = frame.select(F.lit(layer).alias("layer"), F.col(item.get(layer, "id")).alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "check_relationships",
    td.ctes(*td.LAYERS)
    + """, nw AS (SELECT * FROM network WHERE id LIKE 'wb-%')
SELECT 'flowpaths.id in network' AS "check", count(DISTINCT id) AS violations FROM flowpaths
  WHERE id NOT IN (SELECT id FROM network)
UNION ALL SELECT 'network flowpath in flowpaths', count(DISTINCT id) FROM nw WHERE id NOT IN (SELECT id FROM flowpaths)
UNION ALL SELECT 'flowpaths.toid in nexus', count(DISTINCT toid) FROM flowpaths WHERE toid NOT IN (SELECT id FROM nexus)
UNION ALL SELECT 'flowpaths.divide_id in divides', count(DISTINCT divide_id) FROM flowpaths
  WHERE divide_id NOT IN (SELECT divide_id FROM divides)
UNION ALL SELECT 'divides.divide_id in network', count(DISTINCT divide_id) FROM divides
  WHERE divide_id NOT IN (SELECT divide_id FROM network WHERE divide_id IS NOT NULL)
UNION ALL SELECT 'divide-attributes in divides', count(DISTINCT divide_id) FROM divide_attributes
  WHERE divide_id NOT IN (SELECT divide_id FROM divides)
UNION ALL SELECT 'pois in network', count(DISTINCT poi_id) FROM pois
  WHERE poi_id NOT IN (SELECT poi_id FROM network WHERE poi_id IS NOT NULL)
UNION ALL SELECT 'single VPU', greatest(count(DISTINCT vpuid) - 1, 0) FROM network""",
)
def check_relationships(spark, sf):
    return sub.check_relationships(td.layers(spark, sf))


_RNR = (
    td.ctes(*td.LAYERS)
    + """, allowed(vpuid, vpu) AS (SELECT DISTINCT vpuid, vpuid FROM network
  UNION SELECT '08', unnest(['11', '10U', '10L', '08', '07', '05'])),
start AS (SELECT CAST(hf_id AS BIGINT) AS reach_id, hydroseq AS from_seq, hf_mainstem, vpuid
  FROM network WHERE hf_id IS NOT NULL),
feat AS (SELECT s.reach_id, s.vpuid AS own_vpu, n.* FROM network n
  JOIN start s ON n.hf_mainstem = s.hf_mainstem AND n.hydroseq <= s.from_seq
  JOIN allowed a ON a.vpuid = s.vpuid AND a.vpu = n.vpuid),
orders AS (SELECT f.reach_id, min(p."order") AS o FROM feat f JOIN flowpaths p ON p.divide_id = f.divide_id
  WHERE f.hf_id = f.reach_id GROUP BY f.reach_id),
seg1 AS (SELECT DISTINCT f.reach_id, f.own_vpu, p.id, p.poi_id FROM feat f JOIN flowpaths p ON p.divide_id = f.divide_id
  JOIN orders o ON o.reach_id = f.reach_id AND o.o = p."order"),
lake1 AS (SELECT s.reach_id, l.hf_id FROM seg1 s JOIN lakes l ON l.poi_id = CAST(s.poi_id AS BIGINT)
  JOIN allowed a ON a.vpuid = s.own_vpu AND a.vpu = l.vpuid),
cut AS (SELECT f.reach_id, max(f.hf_hydroseq) AS c FROM feat f
  JOIN lake1 l ON l.reach_id = f.reach_id AND l.hf_id = f.hf_id GROUP BY f.reach_id),
feat2 AS (SELECT f.* FROM feat f LEFT JOIN cut c ON c.reach_id = f.reach_id WHERE c.c IS NULL OR f.hf_hydroseq >= c.c),
seg AS (SELECT DISTINCT f.reach_id, f.own_vpu, p.id, p.toid, p.divide_id, p.poi_id, p."order", p.areasqkm
  FROM feat2 f JOIN flowpaths p ON p.divide_id = f.divide_id
  JOIN orders o ON o.reach_id = f.reach_id AND o.o = p."order")
"""
)


def _segments(spark, sf):
    network = td.view(spark, sf, "network")
    reaches = network.where(F.col("hf_id").isNotNull()).select("hf_id").distinct()
    return routing.rnr_segment(td.layers(spark, sf), reaches)


@query("rnr_segment", _RNR + 'SELECT reach_id, id, toid, divide_id, "order", areasqkm FROM seg')
def rnr_segment(spark, sf):
    return _segments(spark, sf)["flowpaths"].select("reach_id", "id", "toid", "divide_id", "order", "areasqkm")


@query(
    "rnr_segment_layers",
    _RNR
    + """, ends AS (SELECT reach_id, id FROM seg UNION SELECT reach_id, toid FROM seg),
places AS (SELECT DISTINCT reach_id, own_vpu, CAST(poi_id AS BIGINT) AS poi_id FROM seg WHERE poi_id IS NOT NULL)
SELECT 'nexus' AS layer, s.reach_id, n.id AS item FROM nexus n JOIN seg s ON s.toid = n.id
UNION ALL SELECT 'divides', s.reach_id, d.divide_id FROM divides d JOIN seg s ON s.divide_id = d.divide_id
UNION ALL SELECT 'divide-attributes', s.reach_id, d.divide_id FROM divide_attributes d
  JOIN seg s ON s.divide_id = d.divide_id
UNION ALL SELECT 'network', e.reach_id, n.id FROM network n JOIN ends e ON e.id = n.id
UNION ALL SELECT 'pois', p.reach_id, x.id FROM pois x JOIN places p ON p.poi_id = x.poi_id
UNION ALL SELECT 'flowpath-attributes', s.reach_id, a.id FROM flowpath_attributes a JOIN seg s ON s.id = a.id
UNION ALL SELECT 'hydrolocations', p.reach_id, x.id FROM hydrolocations x JOIN places p ON p.poi_id = x.poi_id
UNION ALL SELECT 'lakes', p.reach_id, l.res_id FROM lakes l JOIN places p ON p.poi_id = l.poi_id
  JOIN allowed a ON a.vpuid = p.own_vpu AND a.vpu = l.vpuid""",
)
def rnr_segment_layers(spark, sf):
    found = _segments(spark, sf)
    item = {"divides": "divide_id", "divide-attributes": "divide_id", "lakes": "res_id"}
    out = None
    for layer, frame in found.items():
        if layer == "flowpaths":
            continue
        rows = frame.select(F.lit(layer).alias("layer"), "reach_id", F.col(item.get(layer, "id")).alias("item"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "break_at_lakes",
    td.ctes("network", "lakes")
    + """, f AS (SELECT n.hf_mainstem AS reach_id, n.* FROM network n WHERE n.hf_mainstem IS NOT NULL),
l AS (SELECT n.hf_mainstem AS reach_id, x.hf_id FROM lakes x JOIN network n ON n.hf_id = x.hf_id),
cut AS (SELECT f.reach_id, max(f.hf_hydroseq) AS c FROM f JOIN l ON l.reach_id = f.reach_id AND l.hf_id = f.hf_id
  GROUP BY f.reach_id)
SELECT f.reach_id, f.id, f.hf_hydroseq FROM f LEFT JOIN cut c ON c.reach_id = f.reach_id
WHERE c.c IS NULL OR f.hf_hydroseq >= c.c""",
)
def break_at_lakes(spark, sf):
    """Every mainstem cut at its most upstream lake."""
    network = td.view(spark, sf, "network").where(F.col("hf_mainstem").isNotNull())
    features = network.withColumn("reach_id", F.col("hf_mainstem"))
    stems = features.select("reach_id", "hf_id")
    lakes = td.view(spark, sf, "lakes").join(stems, "hf_id")
    return routing.break_at_lakes(features, lakes).select("reach_id", "id", "hf_hydroseq")


@query(
    "full_outer",
    td.ctes("network", "flowpaths")
    + """SELECT coalesce(n.divide_id, f.divide_id) AS divide_id, n.id AS network_id, f.id AS flowpath_id
FROM (SELECT * FROM network WHERE vpuid IN ('01', '05')) n
FULL JOIN (SELECT * FROM flowpaths WHERE vpuid IN ('05', '08')) f ON n.divide_id = f.divide_id""",
)
def full_outer(spark, sf):
    network = td.view(spark, sf, "network").where(F.col("vpuid").isin("01", "05"))
    flowpaths = td.view(spark, sf, "flowpaths").where(F.col("vpuid").isin("05", "08"))
    left = network.select("divide_id", F.col("id").alias("network_id"))
    return routing.full_outer(left, flowpaths.select("divide_id", F.col("id").alias("flowpath_id")))


@query(
    "semi_in",
    td.ctes("divides", "network")
    + "SELECT divide_id, areasqkm FROM divides WHERE divide_id IN (SELECT divide_id FROM network WHERE poi_id IS NOT NULL)",
)
def semi_in(spark, sf):
    ids = td.view(spark, sf, "network").where(F.col("poi_id").isNotNull() & F.col("divide_id").isNotNull())
    return sub.semi_in(td.view(spark, sf, "divides"), "divide_id", ids, "divide_id").select("divide_id", "areasqkm")


@query(
    "semi_or",
    td.ctes("network", "lakes")
    + """, u AS (SELECT 'wb-' || res_id AS id FROM lakes)
SELECT id, toid, type FROM network WHERE id IN (SELECT id FROM u) OR toid IN (SELECT id FROM u)""",
)
def semi_or(spark, sf):
    ids = td.view(spark, sf, "lakes").select(F.concat(F.lit("wb-"), "res_id").alias("id"))
    return sub.semi_or(td.view(spark, sf, "network"), "id", "toid", ids).select("id", "toid", "type")


@query(
    "union_ids",
    td.ctes("network", "flowpaths", "nexus")
    + "SELECT id FROM network UNION SELECT id FROM flowpaths UNION SELECT id FROM nexus",
)
def union_ids(spark, sf):
    return sub.union_ids(*[td.view(spark, sf, n).select("id") for n in ("network", "flowpaths", "nexus")])


@query(
    "intersect_except",
    td.ctes("network", "pois")
    + """SELECT 'both' AS side, id FROM (SELECT id FROM network INTERSECT SELECT id FROM pois)
UNION ALL SELECT 'network only', id FROM (SELECT id FROM network EXCEPT SELECT id FROM pois)""",
)
def intersect_except(spark, sf):
    network, pois = (td.view(spark, sf, n).select("id") for n in ("network", "pois"))
    both = network.intersect(pois).select(F.lit("both").alias("side"), "id")
    return both.unionByName(network.subtract(pois).select(F.lit("network only").alias("side"), "id"))


@query(
    "distinct",
    td.ctes("network")
    + "SELECT DISTINCT vpuid, type, hf_source FROM network",
)
def distinct(spark, sf):
    return td.view(spark, sf, "network").select("vpuid", "type", "hf_source").distinct()


@query(
    "row_index",
    td.ctes("divides")
    + "SELECT divide_id, row_number() OVER (ORDER BY areasqkm, divide_id) AS cat_id FROM divides",
)
def row_number(spark, sf):
    divides = td.view(spark, sf, "divides").select("divide_id", "areasqkm")
    return row_index(divides, ["areasqkm", "divide_id"], "cat_id").select("divide_id", "cat_id")


@query(
    "sorts_limits",
    td.ctes("divides") + "SELECT divide_id, areasqkm FROM divides ORDER BY areasqkm DESC, divide_id LIMIT 100",
)
def sorts_limits(spark, sf):
    """A top-k report."""
    divides = td.view(spark, sf, "divides").select("divide_id", "areasqkm")
    return divides.orderBy(F.desc("areasqkm"), "divide_id").limit(100)
