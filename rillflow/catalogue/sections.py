"""Queries on cross-sections, transects and conflation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.catalogue import testdata as td
from rillflow.catalogue.registry import query, rounded
from rillflow.functions import text as tx
from rillflow.functions.sections import area_below
from rillflow.operators import conflation as cf
from rillflow.operators import xs as xsec
from rillflow.operators.series import append_rows
from rillflow import sinks
from rillflow.plans.workspace import new_path
from rillflow.sinks import arrow_opens, many_files, named_files
from rillflow.sources.files import parse_conflation
from rillflow.sources.files import read_conflation_json as read_files


def sections(spark, sf):
    return td.view(spark, sf, "xs")


def transects(spark, sf):
    """Embeddings as surveyed transects: station = position, elevation = value, spikes above 100."""
    emb = td.driver_table(spark, sf, "embeddings")
    points = F.transform(
        "embedding",
        lambda v, i: F.struct(
            i.cast("double").alias("x"),
            F.round(v.cast("double") * 20 + F.when(F.abs(v) > 0.2, 150.0).otherwise(0.0), 3).alias("Y"),
        ),
    )
    return emb.select(
        "vec_id",
        points.alias("points"),
        F.array((F.col("label") * 2).cast("double"), F.lit(60.0)).alias("banks"),
    )


# Transects in SQL: one row per point, and the sequential repair of elevations above 100 between the banks.
_TRANSECTS = """WITH RECURSIVE pts AS (SELECT vec_id, CAST(i - 1 AS DOUBLE) AS x, CAST(label * 2 AS DOUBLE) AS bank,
  round(CAST(embedding[i] AS DOUBLE) * 20 + CASE WHEN abs(embedding[i]) > 0.2::FLOAT THEN 150 ELSE 0 END, 3) AS y
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
chan AS (SELECT vec_id, x, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY vec_id) AS n,
  lead(y) OVER w AS after FROM pts WHERE x >= bank AND x <= 60 WINDOW w AS (PARTITION BY vec_id ORDER BY x)),
fixed AS (SELECT vec_id, i, n, x, CASE WHEN y > 100 THEN after ELSE y END AS y FROM chan WHERE i = 1
  UNION ALL SELECT c.vec_id, c.i, c.n, c.x, CASE WHEN c.y <= 100 THEN c.y WHEN c.i = c.n THEN f.y
    ELSE (f.y + c.after) / 2 END FROM fixed f JOIN chan c ON c.vec_id = f.vec_id AND c.i = f.i + 1),
slabs AS (SELECT *, max(y) OVER (PARTITION BY vec_id) AS top, lead(x) OVER v AS x2, lead(y) OVER v AS y2
  FROM fixed WINDOW v AS (PARTITION BY vec_id ORDER BY x)),
metrics AS (SELECT vec_id, max(y) - min(y) AS "Ym", max(x) - min(x) AS "TW",
  greatest(0, sum((x2 - x) * (top - (y + y2) / 2))) AS "A", count(*) AS n FROM slabs GROUP BY vec_id)
"""


@query("clean_elev", _TRANSECTS + "SELECT vec_id, i, y FROM fixed")
def clean_elev(spark, sf):
    channel = xsec.channel_points(transects(spark, sf))
    rows = channel.select("vec_id", F.posexplode("channel").alias("p", "point"))
    return rows.select("vec_id", (F.col("p") + 1).cast("bigint").alias("i"), F.col("point.Y").alias("y"))


@query(
    "channel_metrics",
    _TRANSECTS
    + """SELECT vec_id, round("Ym", 6) AS "Ym", round("TW", 6) AS "TW", round("A", 6) AS "A",
  round("A" / ("Ym" * "TW" - "A"), 6) AS r FROM metrics WHERE n > 2 AND "Ym" >= 0.25""",
)
def channel_metrics(spark, sf):
    return rounded(xsec.channel_metrics(transects(spark, sf)).select("vec_id", "Ym", "TW", "A", "r"))


@query(
    "channel_metrics_from_text",
    _TRANSECTS
    + """SELECT vec_id, round("Ym", 6) AS "Ym", round("A", 6) AS "A" FROM metrics WHERE n > 2 AND "Ym" >= 0.25""",
)
def channel_metrics_from_text(spark, sf):
    """The same survey in its text form, parsed back."""
    shown = F.transform("points", lambda p: F.concat(F.lit("("), p["x"], F.lit(", "), p["Y"], F.lit(")")))
    written = transects(spark, sf).select(
        "vec_id",
        F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]")).alias("station_elevation_points"),
        F.concat(F.lit("['"), F.array_join("banks", "', '"), F.lit("']")).alias("bank_stations"),
    )
    return rounded(xsec.channel_metrics(xsec.parse_transects(written)).select("vec_id", "Ym", "A"))


@query(
    "trapezoid_area",
    """WITH p AS (SELECT vec_id, i, embedding[i]::DOUBLE AS y, embedding[i + 1]::DOUBLE AS y2, list_max(embedding)::DOUBLE AS top
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding))) AS i FROM embeddings))
SELECT vec_id, round(sum(top - (y + y2) / 2), 6) AS area FROM p GROUP BY vec_id""",
)
def trapezoid_area(spark, sf):
    emb = td.driver_table(spark, sf, "embeddings")
    points = F.transform("embedding", lambda v, i: F.struct(i.cast("double").alias("x"), v.cast("double").alias("Y")))
    top = F.array_max("embedding").cast("double")
    return rounded(emb.select("vec_id", area_below(points, top).alias("area")))


@query("parse_lists", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def parse_lists(spark, sf):
    emb = td.driver_table(spark, sf, "embeddings")
    shown = F.concat(F.lit("['"), F.array_join(F.col("embedding").cast("array<double>"), "', '"), F.lit("']"))
    parsed = emb.select("vec_id", tx.number_list(shown).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v)
    return parsed.select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query("xs_by_flowpath", td.ctes("xs") + """SELECT flowpath_id, "TW", r, model FROM xs WHERE flowpath_id = '42'""")
def xs_by_flowpath(spark, sf):
    return xsec.subset_xs(sections(spark, sf), identifier="42").select("flowpath_id", "TW", "r", "model")


@query(
    "xs_within_bbox",
    td.ctes("xs")
    + 'SELECT flowpath_id, min_x, min_y, max_x, max_y FROM xs WHERE min_y >= 10 AND min_x >= 20 AND max_y <= 60 AND max_x <= 150',
)
def xs_within_bbox(spark, sf):
    found = xsec.subset_xs(sections(spark, sf), bbox=(10, 20, 60, 150))
    return found.select("flowpath_id", "min_x", "min_y", "max_x", "max_y")


@query("xs_by_domain", td.ctes("xs") + """SELECT flowpath_id, "Ym", domain FROM xs WHERE domain = '/mip_00000003'""")
def xs_by_domain(spark, sf):
    return xsec.xs_by_domain(sections(spark, sf), "/mip_00000003").select("flowpath_id", "Ym", "domain")


@query(
    "reference_for_xs",
    td.ctes("xs", "reference_divides")
    + """SELECT divide_id, areasqkm FROM reference_divides
WHERE flowpath_id IN (SELECT flowpath_id FROM xs WHERE domain = '/mip_00000003')""",
)
def reference_for_xs(spark, sf):
    chosen = xsec.xs_by_domain(sections(spark, sf), "/mip_00000003")
    return xsec.reference_for_xs(chosen, td.view(spark, sf, "reference_divides")).select("divide_id", "areasqkm")


@query(
    "reference_in_extent",
    td.ctes("xs", "reference_flowpaths")
    + """, e AS (SELECT min(min_x) w, min(min_y) s, max(max_x) e, max(max_y) n FROM xs)
SELECT flowpath_id, lengthkm FROM reference_flowpaths, e
WHERE max_x >= e.w AND min_x <= e.e AND max_y >= e.s AND min_y <= e.n""",
)
def reference_in_extent(spark, sf):
    found = xsec.reference_in_extent(sections(spark, sf), td.view(spark, sf, "reference_flowpaths"))
    return found.select("flowpath_id", "lengthkm")


@query(
    "reference_in_extents",
    td.ctes("xs", "reference_flowpaths")
    + """, e AS (SELECT domain, model, min(min_x) w, min(min_y) s, max(max_x) e, max(max_y) n FROM xs GROUP BY domain, model)
SELECT domain, model, flowpath_id, lengthkm FROM reference_flowpaths, e
WHERE max_x >= e.w AND min_x <= e.e AND max_y >= e.s AND min_y <= e.n""",
)
def reference_in_extents(spark, sf):
    """The flowpaths around the sections of each model of each domain."""
    found = xsec.reference_in_extent(sections(spark, sf), td.view(spark, sf, "reference_flowpaths"), ["domain", "model"])
    return found.select("domain", "model", "flowpath_id", "lengthkm")


@query(
    "xs_within_bbox_by_place",
    td.ctes("xs")
    + 'SELECT flowpath_id, min_x, min_y, max_x, max_y FROM xs WHERE min_y >= 10 AND min_x >= 20 AND max_y <= 60 AND max_x <= 150',
)
def xs_within_bbox_by_place(spark, sf):
    """The same box from sections that were written in the order of their places."""
    path = new_path(spark, "xs-by-place")
    sinks.write_xs_by_place(sections(spark, sf), path)
    found = xsec.subset_xs(spark.read.parquet(path), bbox=(10, 20, 60, 150))
    return found.select("flowpath_id", "min_x", "min_y", "max_x", "max_y")


_TIES = ["source_river_station", "order_key", "min_y", "TW", "Ym", "xs_max_elevation", "model"]


@query(
    "representative_xs",
    td.ctes("xs")
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY flowpath_id ORDER BY river_station, source_river_station,
    order_key, min_y, "TW", "Ym", xs_max_elevation, model) AS rn, count(*) OVER (PARTITION BY flowpath_id) AS n FROM xs),
m AS (SELECT flowpath_id, avg(r) FILTER (WHERE isfinite(r)) AS r, avg("TW") AS tw, avg("Ym") AS y
  FROM xs GROUP BY flowpath_id)
SELECT m.flowpath_id, round(m.r, 10) AS r, round(m.tw, 10) AS "TW", round(m.y, 10) AS "Y", o.river_station,
  o.source_river_station, o.model FROM m JOIN o ON o.flowpath_id = m.flowpath_id AND o.rn = (o.n + 1) // 2""",
)
def representative_xs(spark, sf):
    return rounded(xsec.representative_xs(sections(spark, sf), ["source_river_station", "model"], _TIES), 10)


@query(
    "middle_row",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey,
    l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n
  FROM lineitem)
SELECT l_returnflag, l_extendedprice, l_orderkey FROM o WHERE rn = (n + 1) // 2""",
)
def middle_row(spark, sf):
    """Groups that each hold a third of the table."""
    items = td.driver_table(spark, sf, "lineitem")
    order = "l_extendedprice l_orderkey l_linenumber l_partkey l_suppkey l_quantity l_shipdate".split()
    middle = xsec.middle_row(items.select("l_returnflag", *order), ["l_returnflag"], order)
    return middle.select("l_returnflag", "l_extendedprice", "l_orderkey")


@query(
    "attribute_join",
    td.ctes("xs")
    + """SELECT x.flowpath_id, x."TW", x.order_key, p.p_type AS ftype, CAST(p.p_size AS DOUBLE) AS streamorde
FROM xs x LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = x.flowpath_id""",
)
def attribute_join(spark, sf):
    part = td.driver_table(spark, sf, "part")
    vaa = part.select(
        F.col("p_partkey").cast("double").alias("comid"),
        F.col("p_type").alias("ftype"),
        F.col("p_size").cast("double").alias("streamorde"),
    )
    joined = xsec.attribute_join(sections(spark, sf), vaa)
    return joined.select("flowpath_id", "TW", "order_key", "ftype", "streamorde")


@query(
    "metadata_join",
    td.ctes("xs")
    + """SELECT x.flowpath_id, x."TW", x.order_key, p.p_brand AS metdata_units, CAST(p.p_size AS DOUBLE) AS epsg,
  p.p_type AS crs_units FROM xs x LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = x.flowpath_id""",
)
def metadata_join(spark, sf):
    metadata = td.driver_table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("flowpath_id"),
        F.col("p_brand").alias("metdata_units"),
        F.col("p_size").cast("double").alias("epsg"),
        F.col("p_type").alias("crs_units"),
    )
    joined = xsec.metadata_join(sections(spark, sf), metadata)
    return joined.select("flowpath_id", "TW", "order_key", "metdata_units", "epsg", "crs_units")


_HUC = "lpad(CAST(l_suppkey % 7 AS VARCHAR), 8, '0')"


def conflated_sections(spark, sf):
    return sections(spark, sf).withColumn("model", F.concat_ws("-", "model", F.floor(F.col("order_key") / 20_000)))


def conflation(spark, sf):
    """One document per (model, HUC): its reaches, with their sections as end points; models grow in number, not in size.

    Sections are dealt out by place once, for their reaches and the documents, whose text is made where they end up.
    """
    told = ["xs_id", "river", "reach", "thalweg", "xs_max_elevation"]
    dealt = conflated_sections(spark, sf).select("model", "huc", *told, "order_key").repartition("model", "huc")
    one = dealt.withColumn("place", F.xxhash64("model", "huc"))  # not sent along
    reaches = one.groupBy("place", "model", "huc", *told).agg(F.max("order_key").alias("k"))

    def entry(r):
        end = F.struct(r["river"].alias("river"), r["reach"].alias("reach"), r["xs_id"].cast("string").alias("xs_id"), r["thalweg"].alias("min_elevation"),
                       r["xs_max_elevation"].alias("max_elevation"), F.lit("x").alias("note"))
        reach_id = F.concat_ws("-", r["k"], r["xs_id"], r["river"], r["reach"], r["thalweg"].cast("string"), r["xs_max_elevation"].cast("string"))
        body = F.struct(
            end.alias("us_xs"),
            F.when(r["xs_id"] % 2 == 0, end).alias("ds_xs"),
            F.concat(F.lit("n"), r["k"].cast("string")).alias("network_to_id"),
            F.lit(1).alias("metrics"),
        )
        return F.struct(reach_id, body)

    gathered = reaches.groupBy("place", "model", "huc").agg(F.collect_list(F.struct("k", *told)).alias("reaches"))
    entries = F.sort_array(F.transform("reaches", entry))
    documents = gathered.withColumn("value", F.to_json(F.struct(F.map_from_entries(entries).alias("reaches"))))
    parts = [F.concat(F.lit("huc_"), "huc").alias("huc"), F.lit("source_models").alias("kind"), "model", F.lit("conflation.json").alias("file")]
    return documents.select(*parts, "value")


def with_path(documents):
    return documents.select(F.concat_ws("/", F.lit("s3://store"), "huc", "kind", "model", "file").alias("path"), "value")


_REACHES = f"""WITH x AS (SELECT 'model-' || (l_suppkey % 20) || '-' || (l_orderkey // 20000) AS model_id, {_HUC} AS huc, 'river ' || l_returnflag AS river,
  'reach ' || l_linestatus AS reach, l_linenumber AS xs_id, l_discount AS thalweg, l_tax AS mx, l_orderkey, l_partkey
  FROM lineitem),
reaches AS (SELECT model_id, huc, river, reach, xs_id, thalweg, mx, max(l_orderkey) AS k FROM x GROUP BY ALL),
named AS (SELECT *, k || '-' || xs_id || '-' || river || '-' || reach || '-' || CAST(thalweg AS VARCHAR) || '-' || CAST(mx AS VARCHAR) AS reach_id
  FROM reaches)
"""


@query(
    "read_conflation_json",
    _REACHES
    + """SELECT model_id, huc, reach_id, 'n' || k AS network_to_id, river AS us_river, CAST(xs_id AS VARCHAR) AS us_xs_id,
  thalweg AS us_min, CASE WHEN xs_id % 2 = 0 THEN reach END AS ds_reach FROM named""",
)
def read_conflation_json(spark, sf):
    """Documents are written, a packed file each, and read."""
    root = new_path(spark, "conflation")
    places = ["huc", "kind", "model", "file"]
    by_tasks = arrow_opens(root)
    if by_tasks:
        named_files(conflation(spark, sf).withColumn("file", F.concat("file", F.lit(".gz"))), places, root, whole=True)
    else:
        many_files(conflation(spark, sf), places).option("compression", "gzip").text(root)
    rows = read_files(spark, root, written=not by_tasks)
    return rows.select(
        "model_id",
        "huc",
        "reach_id",
        "network_to_id",
        F.col("us_xs.river").alias("us_river"),
        F.col("us_xs.xs_id").alias("us_xs_id"),
        F.col("us_xs.min_elevation").alias("us_min"),
        F.col("ds_xs.reach").alias("ds_reach"),
    )


@query(
    "composite_key_lookup",
    _REACHES
    + """SELECT x.model_id, x.huc, x.l_orderkey AS order_key, x.l_partkey AS part_key, x.xs_id,
  coalesce(r.reach_id, 'None') AS us_reach_id, coalesce('n' || r.k, 'None') AS us_network_to_id,
  coalesce(CASE WHEN r.xs_id % 2 = 0 THEN r.reach_id END, 'None') AS ds_reach_id,
  coalesce(CASE WHEN r.xs_id % 2 = 0 THEN 'n' || r.k END, 'None') AS ds_network_to_id
FROM x LEFT JOIN named r ON r.model_id = x.model_id AND r.huc = x.huc AND r.river = x.river AND r.reach = x.reach
  AND r.xs_id = x.xs_id AND r.thalweg = x.thalweg AND r.mx = x.mx
WHERE (x.model_id, x.huc) IN (SELECT (model_id, huc) FROM reaches)""",
)
def composite_key_lookup(spark, sf):
    xs = conflated_sections(spark, sf).withColumnRenamed("model", "model_id")
    linked = cf.composite_key_lookup(
        xs.select("model_id", "huc", "river_reach_rs", "thalweg", "xs_max_elevation", "order_key", "flowpath_id", "xs_id"),
        parse_conflation(with_path(conflation(spark, sf))),
    )
    return linked.select(
        "model_id",
        "huc",
        "order_key",
        (F.col("flowpath_id").cast("bigint") - 1).alias("part_key"),
        "xs_id",
        "us_reach_id",
        "us_network_to_id",
        "ds_reach_id",
        "ds_network_to_id",
    )


@query(
    "crs_map",
    td.ctes("xs") + "SELECT DISTINCT huc, model, river, coalesce(CAST(epsg AS VARCHAR), 'None') AS epsg, crs_name FROM xs",
)
def crs_map(spark, sf):
    return cf.crs_map(sections(spark, sf))


def _t(lat: str) -> str:
    return f"(tan(pi() / 4 - ({lat}) / 2) / pow((1 - e * sin({lat})) / (1 + e * sin({lat})), e / 2))"


def _m(lat: str) -> str:
    return f"(cos({lat}) / sqrt(1 - e2 * pow(sin({lat}), 2)))"


def _q(lat: str) -> str:
    return f"((1 - e2) * (sin({lat}) / (1 - e2 * pow(sin({lat}), 2)) - ln((1 - e * sin({lat})) / (1 + e * sin({lat}))) / (2 * e)))"


# Survey points in four systems, to geodetic coordinates and from there to the common projection.
_PROJECTED = f"""WITH p AS (SELECT DISTINCT l_linenumber % 4 AS kind, (l_partkey % 100)::DOUBLE AS i, (l_suppkey % 10)::DOUBLE AS j FROM lineitem),
e AS (SELECT 6378137e0 AS a, f / (2 - f) AS n, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM (SELECT 1e0 / 298.257222101e0 AS f)),
k AS (SELECT *, radians(29.5e0) AS a1, radians(45.5e0) AS a2, radians(31e0 + 53e0 / 60) AS s1, radians(30e0 + 7e0 / 60) AS s2,
  radians(29e0 + 2e0 / 3) AS s0, a / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64) AS rect FROM e),
k2 AS (SELECT *, (pow({_m("a1")}, 2) - pow({_m("a2")}, 2)) / ({_q("a2")} - {_q("a1")}) AS an,
  (ln({_m("s1")}) - ln({_m("s2")})) / (ln({_t("s1")}) - ln({_t("s2")})) AS sn FROM k),
k3 AS (SELECT *, pow({_m("a1")}, 2) + an * {_q("a1")} AS ac, a * {_m("s1")} / (sn * pow({_t("s1")}, sn)) AS sf FROM k2),
utm AS (SELECT *, (3300000 + j * 10000) / (0.9996e0 * rect) AS xi, (400000 + i * 2000 - 500000) / (0.9996e0 * rect) AS eta
  FROM p, k3 WHERE kind = 2),
b AS (SELECT *, n / 2 - 2 * pow(n, 2) / 3 + 37 * pow(n, 3) / 96 - pow(n, 4) / 360 AS b1, pow(n, 2) / 48 + pow(n, 3) / 15 - 437 * pow(n, 4) / 1440 AS b2,
  17 * pow(n, 3) / 480 - 37 * pow(n, 4) / 840 AS b3, 4397 * pow(n, 4) / 161280 AS b4 FROM utm),
u AS (SELECT kind, i, j, -99 AS centre, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta)
    - b4 * sin(8 * xi) * cosh(8 * eta) AS xi,
  eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta)
    - b4 * cos(8 * xi) * sinh(8 * eta) AS eta FROM b),
conic AS (SELECT *, (2000000 + i * 5000) * 1200e0 / 3937 - 700000 AS dx,
  sf * pow({_t("s0")}, sn) - ((9800000 + j * 50000) * 1200e0 / 3937 - 3000000) AS dy FROM p, k3 WHERE kind = 3),
chi AS (SELECT kind, i, j, asin(sin(xi) / cosh(eta)) AS chi, radians(-99e0) + atan2(sinh(eta), cos(xi)) AS lam FROM u
  UNION ALL SELECT kind, i, j, pi() / 2 - 2 * atan(pow(sqrt(dx * dx + dy * dy) / sf, 1 / sn)), radians(-100e0 - 1e0 / 3) + atan2(dx, dy) / sn FROM conic),
geo AS (SELECT kind, i, j, lam, chi + (e2 / 2 + 5 * pow(e2, 2) / 24 + pow(e2, 3) / 12 + 13 * pow(e2, 4) / 360) * sin(2 * chi)
    + (7 * pow(e2, 2) / 48 + 29 * pow(e2, 3) / 240 + 811 * pow(e2, 4) / 11520) * sin(4 * chi)
    + (7 * pow(e2, 3) / 120 + 81 * pow(e2, 4) / 1120) * sin(6 * chi) + 4279 * pow(e2, 4) / 161280 * sin(8 * chi) AS phi FROM chi, k3
  UNION ALL SELECT kind, i, j, radians(-100 + i / 10), radians(30 + j / 2) FROM p WHERE kind = 1),
polar AS (SELECT kind, i, j, an * (lam + radians(96e0)) AS theta, a * sqrt(ac - an * {_q("phi")}) / an AS rho,
  a * sqrt(ac - an * {_q("radians(23e0)")}) / an AS rho0 FROM geo, k3)
"""


@query(
    "consolidate_xs",
    _PROJECTED
    + """SELECT 'EPSG:5070' AS crs, 5070 AS epsg, i, j, round(i * 1000, 3) AS x, round(j * 1000, 3) AS y FROM p WHERE kind = 0
UNION ALL SELECT 'EPSG:5070', CASE kind WHEN 1 THEN 4269 WHEN 2 THEN 26914 ELSE 2277 END, i, j,
  round(rho * sin(theta), 3), round(rho0 - rho * cos(theta), 3) FROM polar""",
)
def consolidate_xs(spark, sf):
    """Sections surveyed in four systems, each projected; places that several sections share are listed once."""
    return projected_sections(spark, sf).select("crs", "epsg", "i", "j", "x", "y").distinct()


def projected_sections(spark, sf):
    """All sections, surveyed by their number in the common system, degrees, a UTM zone or a State Plane zone in feet."""

    def by_kind(*values):
        return F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in enumerate(values)])

    i, j = F.col("min_x") % 100, F.col("min_y") % 10
    surveyed = sections(spark, sf).withColumns({"kind": F.col("xs_id") % 4, "i": i, "j": j})
    surveyed = surveyed.withColumns({
        "epsg": by_kind(*map(F.lit, (5070, 4269, 26914, 2277))),
        "x": by_kind(F.col("i") * 1000, F.col("i") / 10 - 100, F.col("i") * 2000 + 400_000, F.col("i") * 5000 + 2_000_000),
        "y": by_kind(F.col("j") * 1000, F.col("j") / 2 + 30, F.col("j") * 10_000 + 3_300_000, F.col("j") * 50_000 + 9_800_000),
    })
    return cf.consolidate_xs(surveyed, "x", "y").withColumns({c: F.round(c, 3) for c in ("x", "y")})


@query(
    "consolidate_xs_rows",
    _PROJECTED
    + """, places AS (SELECT 5070 AS epsg, kind, i, j, round(i * 1000, 3) AS x, round(j * 1000, 3) AS y FROM p WHERE kind = 0
UNION ALL SELECT CASE kind WHEN 1 THEN 4269 WHEN 2 THEN 26914 ELSE 2277 END, kind, i, j,
  round(rho * sin(theta), 3), round(rho0 - rho * cos(theta), 3) FROM polar)
SELECT 'model-' || (l_suppkey % 20) AS model, lpad(CAST(l_suppkey % 7 AS VARCHAR), 8, '0') AS huc,
  'river ' || l_returnflag AS river, 'reach ' || l_linestatus AS reach, l_linenumber AS xs_id, l_orderkey AS order_key,
  CAST(l_partkey + 1 AS VARCHAR) AS flowpath_id, l_discount AS thalweg, l_tax AS xs_max_elevation, 'EPSG:5070' AS crs, epsg, x, y
FROM lineitem JOIN places ON kind = l_linenumber % 4 AND i = l_partkey % 100 AND j = l_suppkey % 10""",
)
def consolidate_xs_rows(spark, sf):
    """Every section with its key and its projected coordinates."""
    return projected_sections(spark, sf).select(
        "model", "huc", "river", "reach", "xs_id", "order_key", "flowpath_id", "thalweg", "xs_max_elevation", "crs", "epsg", "x", "y"
    )


# The same for a transverse zone, by series about the foot of the meridian, and an oblique one (Snyder 1987).
_MERCATOR = f"""WITH p AS (SELECT DISTINCT l_linenumber % 2 AS kind, l_partkey % 100 AS i, l_suppkey % 10 AS j FROM lineitem),
k AS (SELECT *, radians(29.5e0) AS a1, radians(45.5e0) AS a2, radians(30e0) AS o FROM
  (SELECT 6378137e0 AS a, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM (SELECT 1e0 / 298.257222101e0 AS f))),
k2 AS (SELECT *, (pow({_m("a1")}, 2) - pow({_m("a2")}, 2)) / ({_q("a2")} - {_q("a1")}) AS an, e2 / (1 - e2) AS ep,
  (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2)) AS e1 FROM k),
k3 AS (SELECT *, pow({_m("a1")}, 2) + an * {_q("a1")} AS ac FROM k2),
west AS (SELECT p.*, k3.*, (i - 50) * 500e0 / 0.9999e0 AS dx, o - (3 * e1 / 2 - 9 * pow(e1, 3) / 16) * sin(2 * o) + (15 * pow(e1, 2) / 16 - 15 * pow(e1, 4) / 32) * sin(4 * o)
  - 35 * pow(e1, 3) / 48 * sin(6 * o) + 315 * pow(e1, 4) / 512 * sin(8 * o)
  + (j * 30000 + 50000) / 0.9999e0 / (a / (1 + e1) * (1 + pow(e1, 2) / 4 + pow(e1, 4) / 64)) AS mu FROM p, k3 WHERE kind = 0),
foot AS (SELECT *, mu + (3 * e1 / 2 - 27 * pow(e1, 3) / 32) * sin(2 * mu) + (21 * pow(e1, 2) / 16 - 55 * pow(e1, 4) / 32) * sin(4 * mu)
  + 151 * pow(e1, 3) / 96 * sin(6 * mu) + 1097 * pow(e1, 4) / 512 * sin(8 * mu) AS f1 FROM west),
foot2 AS (SELECT *, ep * pow(cos(f1), 2) AS c, pow(tan(f1), 2) AS t, a / sqrt(1 - e2 * pow(sin(f1), 2)) AS n1,
  a * (1 - e2) / pow(1 - e2 * pow(sin(f1), 2), 1.5) AS r1 FROM foot),
foot3 AS (SELECT *, dx / n1 AS d FROM foot2),
tm AS (SELECT kind, i, j, f1 - n1 * tan(f1) / r1 * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep) * pow(d, 4) / 24
    + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep - 3 * c * c) * pow(d, 6) / 720) AS phi,
  radians(-84e0 - 1e0 / 6) + (d - (1 + 2 * t + c) * pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep + 24 * t * t) * pow(d, 5) / 120) / cos(f1) AS lam
  FROM foot3),
h AS (SELECT *, radians(57e0) AS fc, radians(323 + 7e0 / 60 + 48.3685e0 / 3600) AS al FROM k3),
h2 AS (SELECT *, sqrt(1 + e2 * pow(cos(fc), 4) / (1 - e2)) AS hb, {_t("fc")} AS t0 FROM h),
h3 AS (SELECT *, a * hb * 0.9999e0 * sqrt(1 - e2) / (1 - e2 * pow(sin(fc), 2)) AS ha, hb * sqrt(1 - e2) / (cos(fc) * sqrt(1 - e2 * pow(sin(fc), 2))) AS hd FROM h2),
h4 AS (SELECT *, hd + sqrt(hd * hd - 1) AS hf, asin(sin(al) / hd) AS g0 FROM h3),
h5 AS (SELECT *, hf * pow(t0, hb) AS hh, radians(-133e0 - 2e0 / 3) - asin((hf - 1 / hf) / 2 * tan(g0)) / hb AS l0 FROM h4),
skew AS (SELECT p.kind, p.i, p.j, h5.*, (i * 2000 + 750000 - 5000000) * cos(al) - (j * 30000 + 500000 + 5000000) * sin(al) AS v,
  (j * 30000 + 500000 + 5000000) * cos(al) + (i * 2000 + 750000 - 5000000) * sin(al) AS u FROM p, h5 WHERE kind = 1),
skew2 AS (SELECT *, sinh(-hb * v / ha) AS s, cosh(hb * v / ha) AS t, sin(hb * u / ha) AS w FROM skew),
skew3 AS (SELECT *, (w * cos(g0) + s * sin(g0)) / t AS z FROM skew2),
chi AS (SELECT *, pi() / 2 - 2 * atan(pow(hh / sqrt((1 + z) / (1 - z)), 1 / hb)) AS chi FROM skew3),
spots AS (SELECT kind, i, j, lam, pi() / 2 - 2 * atan({_t("phi")}) AS chi FROM tm, k3
  UNION ALL SELECT kind, i, j, l0 - atan2(s * cos(g0) - w * sin(g0), cos(hb * u / ha)) / hb, chi FROM chi),
geo AS (SELECT kind, i, j, lam, chi + (e2 / 2 + 5 * pow(e2, 2) / 24 + pow(e2, 3) / 12 + 13 * pow(e2, 4) / 360) * sin(2 * chi)
    + (7 * pow(e2, 2) / 48 + 29 * pow(e2, 3) / 240 + 811 * pow(e2, 4) / 11520) * sin(4 * chi)
    + (7 * pow(e2, 3) / 120 + 81 * pow(e2, 4) / 1120) * sin(6 * chi) + 4279 * pow(e2, 4) / 161280 * sin(8 * chi) AS phi FROM spots, k3),
polar AS (SELECT kind, i, j, an * (lam + radians(96e0)) AS theta, a * sqrt(ac - an * {_q("phi")}) / an AS rho,
  a * sqrt(ac - an * {_q("radians(23e0)")}) / an AS rho0 FROM geo, k3)
"""


@query(
    "consolidate_xs_mercator",
    _MERCATOR
    + """SELECT l_orderkey AS order_key, l_linenumber AS xs_id, CAST(l_partkey + 1 AS VARCHAR) AS flowpath_id,
  CASE kind WHEN 0 THEN 26967 ELSE 26931 END AS epsg, round(rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y
FROM lineitem JOIN polar ON kind = l_linenumber % 2 AND i = l_partkey % 100 AND j = l_suppkey % 10""",
)
def consolidate_xs_mercator(spark, sf):
    """Sections surveyed in a transverse State Plane zone and in the oblique one, all of them projected."""
    i, j = (F.col("min_x") % 100).cast("double"), (F.col("min_y") % 10).cast("double")
    west = F.col("xs_id") % 2 == 0
    surveyed = sections(spark, sf).withColumns({
        "epsg": F.when(west, 26967).otherwise(26931),
        "x": F.when(west, (i - 50) * 500 + 700_000).otherwise(i * 2000 + 750_000),
        "y": F.when(west, j * 30_000 + 50_000).otherwise(j * 30_000 + 500_000),
    })
    projected = cf.consolidate_xs(surveyed, "x", "y")
    return projected.select("order_key", "xs_id", "flowpath_id", "epsg", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    "append_rows",
    td.ctes("xs", "reference_divides")
    + """SELECT flowpath_id, CAST(NULL AS VARCHAR) AS divide_id, model FROM xs
UNION ALL SELECT flowpath_id, divide_id, NULL FROM reference_divides""",
)
def rows_appended(spark, sf):
    xs = sections(spark, sf).select("flowpath_id", "model")
    divides = td.view(spark, sf, "reference_divides").select("flowpath_id", "divide_id")
    return append_rows(xs, divides).select("flowpath_id", "divide_id", "model")


@query(
    "text_functions",
    td.ctes("xs")
    + """SELECT CAST(CAST(min_x AS BIGINT) AS VARCHAR) AS id_text, regexp_replace(river, '[^A-Za-z0-9_]', '_', 'g') AS safe,
  river || ' ' || reach || ' ' || xs_id AS river_key, huc AS part, coalesce(CAST(epsg AS VARCHAR), 'None') AS known,
  model AS bare FROM xs""",
)
def text_functions(spark, sf):
    path = F.concat(F.lit("a/"), "huc", F.lit("/b"))
    return sections(spark, sf).select(
        tx.id_text(F.col("min_x")).alias("id_text"),
        tx.safe_name(F.col("river")).alias("safe"),
        tx.river_reach_key(F.col("river"), F.col("reach"), F.col("xs_id")).alias("river_key"),
        tx.path_part(path, -2).alias("part"),
        tx.or_none(F.col("epsg")).alias("known"),
        tx.without_suffix(F.concat("model", F.lit(".parquet")), ".parquet").alias("bare"),
    )


@query("python_float", "SELECT l_extendedprice, l_discount, CAST(l_extendedprice / 1e8 AS VARCHAR) AS small, CAST(l_extendedprice * 1e12 AS VARCHAR) AS large FROM lineitem")
def python_float(spark, sf):
    items = td.driver_table(spark, sf, "lineitem")
    price = F.col("l_extendedprice")
    return items.select(
        "l_extendedprice",
        "l_discount",
        tx.python_float(price / 1e8).alias("small"),
        tx.python_float(price * 1e12).alias("large"),
    )


