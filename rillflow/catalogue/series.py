"""Queries on streamflow series, rasters and scalar functions of time and place."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rillflow.catalogue import testdata as td
from rillflow.catalogue.registry import query, rounded
from rillflow.functions import geo, physics, times
from rillflow.functions.text import safe_name
from rillflow.operators import series as ts
from rillflow.operators import zonal as zn
from rillflow.operators.conflation import with_lonlat
from rillflow.plans.workspace import materialize, new_path
from rillflow.sinks import arrow_opens, many_files, named_files
from rillflow.sources import files, grids
from rillflow.streaming.observations import observations, stream_observations


def streamflow(spark, sf):
    """Hourly mean of a user's events as a gauge's flow; error events are the second series."""
    events = td.driver_table(spark, sf, "events")
    error = F.col("event_type") == "error"
    return events.groupBy(F.col("user_id").cast("string").alias("id"), times.hour_of(F.col("ts")).alias("time")).agg(
        F.avg(F.when(~error, F.col("value"))).alias("q_cms"),
        F.avg(F.when(error, F.col("value"))).alias("q_cms_denoted_3"),
    )


_FLOW = """WITH flow AS (SELECT CAST(user_id AS VARCHAR) AS id, date_trunc('hour', ts) AS time,
  avg(value) FILTER (WHERE event_type <> 'error') AS q_cms,
  avg(value) FILTER (WHERE event_type = 'error') AS q_cms_denoted_3 FROM events GROUP BY 1, 2)
"""


@query(
    "streamflow_range",
    _FLOW
    + """SELECT id, time, round(q_cms, 6) AS q_cms, round(q_cms_denoted_3, 6) AS q_cms_denoted_3 FROM flow
WHERE id = '8' AND time >= '2024-01-05 00:00:00' AND time <= '2024-01-20 12:00:00' AND q_cms IS NOT NULL""",
)
def streamflow_range(spark, sf):
    return rounded(ts.streamflow_range(streamflow(spark, sf), "8", "2024-01-05 00:00:00", "2024-01-20 12:00:00"))


@query(
    "streamflow_request",
    _FLOW
    + """SELECT time, round(q_cms, 6) AS q_cms, round(q_cms * 3, 6) AS q_cms_denoted_3 FROM flow
WHERE id = '8' AND q_cms IS NOT NULL""",
)
def streamflow_request(spark, sf):
    flow = streamflow(spark, sf).withColumn("q_cms_denoted_3", F.col("q_cms") * 3)
    return rounded(ts.streamflow_request(flow, "8", "2024-01-01 00:00:00", "2024-12-31 00:00:00"))


@query(
    "streamflow_request_open",
    _FLOW
    + """SELECT time, round(q_cms, 6) AS q_cms FROM flow
WHERE id = '8' AND time >= '2024-01-05 06:00:00' AND q_cms IS NOT NULL""",
)
def streamflow_request_open(spark, sf):
    """From a time given as text on, of a gauge whose second series is empty."""
    flow = streamflow(spark, sf).withColumn("q_cms_denoted_3", F.lit(None).cast("double"))
    return rounded(ts.streamflow_request(flow, "8", "2024-01-05 06"))


@query(
    "streamflow_info",
    _FLOW
    + """SELECT id, count(q_cms) AS total_records, min(time) FILTER (WHERE q_cms IS NOT NULL) AS start_time,
  max(time) FILTER (WHERE q_cms IS NOT NULL) AS end_time, round(count(q_cms) * 25 / 1048576, 2) AS csv_mb,
  round(count(q_cms) * 8 / 1048576, 2) AS parquet_mb FROM flow GROUP BY id""",
)
def streamflow_info(spark, sf):
    return ts.streamflow_info(streamflow(spark, sf))


@query(
    "streamflow_available",
    _FLOW
    + """, ids AS (SELECT DISTINCT id FROM flow)
SELECT id, (SELECT count(*) FROM ids) AS total, least(100, (SELECT count(*) FROM ids)) AS showing
FROM ids ORDER BY id LIMIT 100""",
)
def streamflow_available(spark, sf):
    ids, total = ts.streamflow_available(streamflow(spark, sf), 100)
    return ids.select("id", F.lit(total).cast("bigint").alias("total"), F.lit(min(100, total)).cast("bigint").alias("showing"))


@query(
    "unpivot_observations",
    """SELECT date_trunc('hour', ts) AS time, 'gage.' || event_type AS id, round(avg(value), 6) AS q_cms
FROM events GROUP BY 1, 2""",
)
def unpivot_observations(spark, sf):
    """A wide table with a column per event type."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    events = td.driver_table(spark, sf, "events")
    wide = events.groupBy(times.hour_of(F.col("ts")).alias("time")).agg(
        *[F.avg(F.when(F.col("event_type") == k, F.col("value"))).alias(f"gage.{k}") for k in kinds]
    )
    return rounded(ts.unpivot_observations(wide).where(F.col("q_cms").isNotNull()))


def daily(spark, sf):
    """Daily mean per event type and user, at a time of day that depends on the user."""
    events = td.driver_table(spark, sf, "events")
    hours = F.make_dt_interval(F.lit(0), (F.col("user_id") % 24).cast("int"))
    day = F.to_date("ts").cast("timestamp_ntz")
    return events.groupBy(F.col("user_id").alias("id"), (day + hours).alias("time")).agg(
        F.max("value").alias("result"), F.lit("daily").alias("timestep")
    )


_DAILY = """WITH d AS (SELECT user_id AS id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_hours(user_id % 24) AS time,
  max(value) AS result FROM events GROUP BY 1, 2),
n AS (SELECT *, lag(time) OVER w AS p, lead(time) OVER w AS a FROM d WINDOW w AS (PARTITION BY id ORDER BY time)),
span AS (SELECT id, date_trunc('day', min(time)) AS s, date_trunc('day', max(time)) + INTERVAL 1 DAY AS e
  FROM d GROUP BY id),
grid AS (SELECT id, unnest(generate_series(s, e - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS t FROM span)
"""


@query(
    "upsample_daily_nearest",
    _DAILY
    + """SELECT g.id, g.t AS time, n.result FROM grid g JOIN n ON n.id = g.id
  AND (n.p IS NULL OR g.t - n.p >= n.time - g.t) AND (n.a IS NULL OR g.t - n.time < n.a - g.t)""",
)
def upsample_daily_nearest(spark, sf):
    return ts.upsample_daily_nearest(daily(spark, sf)).select("id", "time", "result")


@query(
    "timeslice_rows",
    _DAILY
    + """SELECT CAST(g.id AS VARCHAR) AS "stationId", strftime(g.t, '%Y-%m-%d_%H:%M:%S') AS time, n.result AS discharge,
  100 AS discharge_quality FROM grid g JOIN n ON n.id = g.id
  AND (n.p IS NULL OR g.t - n.p >= n.time - g.t) AND (n.a IS NULL OR g.t - n.time < n.a - g.t)""",
)
def timeslice_rows(spark, sf):
    return ts.timeslice_rows(ts.upsample_daily_nearest(daily(spark, sf))).drop("queryTime")


@query(
    "valid_release_items",
    """SELECT l_orderkey AS item, l_partkey AS part FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 3""",
)
def valid_release_items(spark, sf):
    items = td.driver_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        F.col("l_partkey").alias("part"),
        F.when(F.col("l_returnflag") == "A", "Lake/Reservoir Outflow").otherwise("Other").alias("parameterGroup"),
        F.when(F.col("l_linestatus") == "F", "Lake/Reservoir Release - Total").otherwise("Level").alias("parameterName"),
        F.when(F.col("l_linenumber") == 3, "cfs").otherwise("ft").alias("parameterUnit"),
    )
    return ts.valid_release_items(items).select("item", "part")


@query(
    "read_gage_csvs",
    """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 2 END AS collection FROM events),
f AS (SELECT user_id, max(collection) AS last FROM e GROUP BY 1)
SELECT 'G' || (e.user_id % 500) AS id,
  CASE e.user_id % 3 WHEN 0 THEN 'ENVCA' WHEN 1 THEN 'CADWR' ELSE 'TXDOT' END AS gage_type,
  date_trunc('second', ts) + INTERVAL 8 HOUR AS time, round(value, 6) AS q_cms
FROM e JOIN f ON f.user_id = e.user_id AND e.collection = f.last""",
)
def read_gage_csvs(spark, sf):
    """Gauge files in two collections are written and read; a gauge's later collection replaces the earlier one."""
    events = td.driver_table(spark, sf, "events")
    folder = F.element_at(F.array(F.lit("ENVCA"), F.lit("CADWR"), F.lit("USGS")), (F.col("user_id") % 3 + 1).cast("int"))
    collection = F.when(F.col("event_type") == "error", "2024-01").otherwise("2024-02")
    name = F.concat(F.lit("G"), (F.col("user_id") % 500).cast("string"), F.lit("_"), F.col("user_id"), F.lit(".csv"))
    lines = events.select(
        folder.alias("folder"),
        collection.alias("collection"),
        name.alias("file"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-08:00")).alias("dateTime"),
        F.col("value").alias("q_cms"),
    )
    root = new_path(spark, "gages")
    places = ["folder", "collection", "file"]
    by_tasks = arrow_opens(root)
    if by_tasks:
        named_files(lines.select(*places, F.to_csv(F.struct("dateTime", "q_cms")).alias("value")), places, root, "dateTime,q_cms")
    else:
        many_files(lines, places).option("header", "true").csv(root)
    return rounded(files.read_gage_csvs(spark, root, "dateTime string, q_cms double", written=not by_tasks))


@query(
    "read_marked_csv",
    """SELECT 'station-' || user_id AS station, CAST(date_trunc('second', ts) AS VARCHAR) AS at, event_type AS "Timestep",
  value AS "Result" FROM events""",
)
def read_marked_csv(spark, sf):
    """One download per user is written, with preamble, marker, header and rows, and read in splits."""
    events = td.driver_table(spark, sf, "events")
    line = F.concat_ws(
        ",",
        F.concat(F.lit('"'), F.col("event_type"), F.lit('"')),
        F.col("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    )
    station = F.concat(F.lit("station-"), "user_id").alias("station")
    top = F.posexplode(F.array(*map(F.lit, ["Reservoir, a", "units cfs", "#SERIES DATA#", "Timestep,Result,Datetime (UTC)"])))
    heads = events.select(station).distinct().select("station", top.alias("at", "value"))
    lines = heads.unionByName(events.select(station, F.lit(9).alias("at"), line.alias("value")))
    root = new_path(spark, "downloads")
    many_files(lines, ["station"], "at").text(root)
    rows = files.read_marked_csv(spark, root, {"Datetime (UTC)": "string", "Timestep": "string", "Result": "double"})
    station = F.regexp_extract("path", "station=([^/]*)", 1).alias("station")
    return rows.select(station, F.col("`Datetime (UTC)`").alias("at"), "Timestep", "Result")


@query(
    "stream_observations",
    "SELECT CAST(user_id AS VARCHAR) AS id, date_trunc('hour', ts) AS time, round(avg(value), 6) AS value FROM events GROUP BY 1, 2",
)
def stream_observations_twice(spark, sf):
    """Hourly means without errors arrive first; then hours that only errors have, corrected hours, and repeats of others."""
    source, out, checkpoint = (new_path(spark, f"stream-{n}") for n in ("in", "out", "checkpoint"))
    events = td.driver_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), times.hour_of(F.col("ts")).alias("time"), "event_type", "value")
    error = F.col("event_type") == "error"
    hours = events.groupBy("id", "time").agg(F.avg(F.when(~error, F.col("value"))).alias("plain"), F.avg("value").alias("value"), F.max(error).alias("late"))
    hours = materialize(hours, "hours")
    arrivals = [hours.where("plain is not null").select("id", "time", F.col("plain").alias("value")), hours.where("late or id % 7 = 0").select("id", "time", "value")]
    for rows in arrivals:
        rows.write.mode("append").parquet(source)
        stream_observations(spark, source, rows.schema, out, checkpoint).awaitTermination()
    return rounded(observations(spark, out, arrivals[0].schema))


@query(
    "parse_times",
    """SELECT l_orderkey, l_shipdate AS day, CAST(strftime(l_shipdate, '%Y-01-01') AS TIMESTAMP) AS year,
  l_shipdate + to_hours(l_linenumber) AS hour, CAST(NULL AS TIMESTAMP) AS bad FROM lineitem""",
)
def parse_times(spark, sf):
    items = td.driver_table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return items.select(
        "l_orderkey",
        times.parse_time(day).alias("day"),
        times.parse_time(F.date_format("l_shipdate", "yyyy")).alias("year"),
        times.parse_time_strict(F.concat_ws(" ", day, F.col("l_linenumber"))).alias("hour"),
        times.parse_time(F.concat(F.lit("on "), day)).alias("bad"),
    )


@query("to_naive_utc", "SELECT l_orderkey, l_shipdate + INTERVAL 5 HOUR AS shifted, l_shipdate AS plain FROM lineitem")
def to_naive_utc(spark, sf):
    items = td.driver_table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")
    return items.select(
        "l_orderkey",
        times.to_naive_utc(F.concat(day, F.lit("-05:00"))).alias("shifted"),
        times.to_naive_utc(day).alias("plain"),
    )


def rasters(spark, sf):
    """The folder of a raster for each month, named by its first day."""
    items = td.driver_table(spark, sf, "lineitem")
    month = F.concat(F.lit("nlcd_v2_"), F.date_format("l_shipdate", "yyyyMM01"), F.lit("_ldasin.tif"))
    cells = items.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"), F.dayofmonth("l_shipdate").alias("day"), month.alias("of"))
    root = new_path(spark, "rasters")
    cells.repartition("of").write.partitionBy("of").parquet(root)
    return root


@query("concat_time", "SELECT l_orderkey, l_linenumber, l_extendedprice AS value, CAST(l_shipdate AS DATE) AS date FROM lineitem")
def concat_time(spark, sf):
    """Rasters are written and read; a cell's date is the one that its file is named by, and the day in it."""
    cells = grids.concat_time(spark, rasters(spark, sf))
    return cells.select("l_orderkey", "l_linenumber", "value", F.date_add("date", F.col("day") - 1).alias("date"))


@query("concat_time_year", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS cells, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL")
def concat_time_year(spark, sf):
    """The same rasters by year."""
    cells = grids.concat_time(spark, rasters(spark, sf), "year")
    return cells.groupBy("year").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("value"), 2).alias("total"))


@query("sanitize", """SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS file FROM part""")
def sanitize(spark, sf):
    return td.driver_table(spark, sf, "part").select("p_partkey", safe_name(F.col("p_name")).alias("file"))


_A, _FLAT = 6378137.0, 1 / 298.257222101
_E2 = 2 * _FLAT - _FLAT**2


def _albers_sql(x: str, y: str) -> tuple[str, str]:
    """Snyder's inverse Albers formulas in SQL, with constants from the projection's parameters."""
    e = math.sqrt(_E2)
    p1, p2, p0 = (math.radians(v) for v in (29.5, 45.5, 23.0))

    def q(p):
        s = math.sin(p)
        return (1 - _E2) * (s / (1 - _E2 * s * s) - 1 / (2 * e) * math.log((1 - e * s) / (1 + e * s)))

    def m(p):
        return math.cos(p) / math.sqrt(1 - _E2 * math.sin(p) ** 2)

    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    c = m(p1) ** 2 + n * q(p1)
    rho0 = _A * math.sqrt(c - n * q(p0)) / n
    beta = f"asin(({c!r} - (pow({x}, 2) + pow({rho0!r} - {y}, 2)) * {n * n / _A / _A!r}) / {n!r} / {q(math.pi / 2)!r})"
    k1 = _E2 / 3 + 31 * _E2**2 / 180 + 517 * _E2**3 / 5040
    k2 = 23 * _E2**2 / 360 + 251 * _E2**3 / 3780
    k3 = 761 * _E2**3 / 45360
    lat = f"degrees({beta} + {k1!r} * sin(2 * {beta}) + {k2!r} * sin(4 * {beta}) + {k3!r} * sin(6 * {beta}))"
    lon = f"(-96 + degrees(atan2({x}, {rho0!r} - {y}) / {n!r}))"
    return lon, lat


LON_SQL, LAT_SQL = _albers_sql("centroid_x", "centroid_y")


@query(
    "albers_to_wgs84",
    td.ctes("divide-attributes")
    + f" SELECT divide_id, round({LON_SQL}, 6) AS lon, round({LAT_SQL}, 6) AS lat FROM divide_attributes",
)
def albers_to_wgs84(spark, sf):
    located = with_lonlat(td.view(spark, sf, "divide-attributes"), "centroid_x", "centroid_y")
    return rounded(located.select("divide_id", "lon", "lat"))


@query(
    "lonlat_to_albers",
    td.ctes("divide-attributes")
    + " SELECT divide_id, round(centroid_x, 2) AS x, round(centroid_y, 2) AS y FROM divide_attributes",
)
def lonlat_to_albers(spark, sf):
    """There and back again."""
    located = with_lonlat(td.view(spark, sf, "divide-attributes"), "centroid_x", "centroid_y")
    x, y = geo.lonlat_to_albers(F.col("lon"), F.col("lat"))
    return rounded(located.select("divide_id", x.alias("x"), y.alias("y")), 2)


@query(
    "unit_conversions",
    td.ctes("divides")
    + """SELECT divide_id, round(areasqkm * 0.01, 6) AS m, round_even(lengthkm * 1000, 0) AS whole_m,
  round(round_even(101325 * pow(1 - 0.0065 * (6356766 * areasqkm / (6356766 + areasqkm)) / 288.15,
    9.80665 / (0.0065 * 287.05287)), 4), 3) AS pressure,
  CASE WHEN areasqkm < 930 THEN 0.75 WHEN areasqkm < 960 THEN 0.3 ELSE 0.2 END::DOUBLE AS albedo,
  CASE WHEN CAST(floor(areasqkm) AS BIGINT) % 20 = 16 THEN 2 ELSE 1 END AS surface FROM divides""",
)
def unit_conversions(spark, sf):
    area = F.col("areasqkm")
    cover = F.when(area < 930, "snow").when(area < 960, "ice").otherwise("other")
    return td.view(spark, sf, "divides").select(
        "divide_id",
        F.round(physics.cm_to_m(area), 6).alias("m"),
        physics.km_to_whole_m(F.col("lengthkm")).alias("whole_m"),
        F.round(physics.standard_pressure(area), 3).alias("pressure"),
        physics.landcover_albedo(cover).alias("albedo"),
        physics.surface_type(F.floor(area) % 20).alias("surface"),
    )


# A diamond per part on a lattice, as WKB; sizes differ, so neighbours overlap.
_DIAMOND = (
    "(p_partkey % 97) * 1000 + 13.5",
    "(p_partkey % 7 + 1) * 1000 + 7.25",
    "300.0 + p_size * 40",
)


@F.pandas_udf(BinaryType())
def diamond_outline(x: pd.Series, y: pd.Series, r: pd.Series) -> pd.Series:
    import struct

    def ring(a, b, c):
        points = [a - c, b, a, b + c, a + c, b, a, b - c, a - c, b]
        return struct.pack("<BIII10d", 1, 3, 1, 5, *points)

    return pd.Series([ring(a, b, c) for a, b, c in zip(x, y, r, strict=True)])


def diamonds(spark, sf):
    cx, cy, half = (F.expr(e).cast("double") for e in _DIAMOND)
    # a few small files hold all parts; their outlines are every core's work
    part = td.driver_table(spark, sf, "part").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return part.select((F.col("p_partkey") + 1).alias("cat_id"), diamond_outline(cx, cy, half).alias("geometry"))


def bounded(df):
    return df.withColumn("_b", geo.wkb_bounds("geometry")).select(*df.columns, "_b.*")


_DIAMONDS_SQL = "WITH poly AS (SELECT p_partkey + 1 AS cat_id, {}::DOUBLE AS cx, {}::DOUBLE AS cy, {}::DOUBLE AS r FROM part)".format(*_DIAMOND)


@query("wkb_bounds", _DIAMONDS_SQL + " SELECT cat_id, cx - r AS min_x, cy - r AS min_y, cx + r AS max_x, cy + r AS max_y FROM poly")
def wkb_bounds(spark, sf):
    return bounded(diamonds(spark, sf)).drop("geometry")


@query(
    "cells_in_polygons",
    _DIAMONDS_SQL
    + """, c AS (SELECT DISTINCT (l_suppkey * 1000)::DOUBLE AS x, (l_linenumber * 1000)::DOUBLE AS y FROM lineitem)
SELECT c.x, c.y, max(p.cat_id) AS cat_id FROM c JOIN poly p
  ON c.x BETWEEN p.cx - p.r AND p.cx + p.r AND abs(c.x - p.cx) + abs(c.y - p.cy) < p.r GROUP BY c.x, c.y""",
)
def cells_in_polygons(spark, sf):
    cells = td.view(spark, sf, "grid").select("x", "y").distinct()
    polygons = materialize(diamonds(spark, sf), "polygons")
    return zn.cells_in_polygons(cells, polygons)


def cells(spark, sf):
    return td.view(spark, sf, "cells")


def _zonal(name, statistic, value, sql, column=None):
    def run(spark, sf):
        data = cells(spark, sf)
        if column is not None:
            data = data.withColumn(value, F.expr(column))
        return rounded(zn.zonal(data, statistic, value, "v"), 5)

    query(name, td.ctes("cells") + f" SELECT divide_id, round({sql}, 5) AS v FROM cells GROUP BY divide_id")(run)


_zonal("zonal_mean", "mean", "value", "sum(value * weight) / sum(weight)")
_zonal("zonal_mean_elevation_cm", "mean", "cm", "sum(value * 100 * weight) / sum(weight)", "value * 100")
_zonal("zonal_geom_mean", "geom_mean", "psi", "-exp(avg(ln(value)))", "-value")
_zonal(
    "zonal_circular_mean",
    "circ_mean",
    "aspect",
    "(degrees(atan2(avg(sin(radians(aspect))), avg(cos(radians(aspect))))) + 360) % 360",
)


@query(
    "zonal_mode",
    td.ctes("cells")
    + """, s AS (SELECT divide_id, class_value, sum(weight) AS w FROM cells GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY divide_id ORDER BY round(w, 9) DESC, class_value) AS rn FROM s)
SELECT divide_id, class_value AS v FROM r WHERE rn = 1""",
)
def zonal_mode(spark, sf):
    exact = cells(spark, sf).withColumn("weight", F.col("weight").cast("decimal(12,2)"))
    return zn.zonal_mode(exact, "class_value", "v")


@query(
    "zonal_equal_population",
    td.ctes("cells")
    + """, t AS (SELECT divide_id, value, ntile(4) OVER (PARTITION BY divide_id ORDER BY value) AS bin,
  count(*) OVER (PARTITION BY divide_id) AS n FROM cells)
SELECT divide_id, CAST(bin AS INTEGER) AS bin, round(avg(value), 5) AS v, round(count(*) / max(n), 6) AS frequency
FROM t GROUP BY divide_id, bin""",
)
def zonal_equal_population(spark, sf):
    bins = zn.zonal_equal_population(cells(spark, sf))
    return bins.select("divide_id", "bin", F.round("v", 5).alias("v"), F.round("frequency", 6).alias("frequency"))


@query(
    "zonal_distribution_json",
    td.ctes("cells") + " SELECT divide_id, least(4, count(*)) AS bins FROM cells GROUP BY divide_id",
)
def zonal_distribution_json(spark, sf):
    from rillflow.operators.params import twi_bins

    text = zn.distribution_json(zn.zonal_equal_population(cells(spark, sf)))
    return text.select("divide_id", F.size(twi_bins(F.col("`dist_4.twi`"))).cast("bigint").alias("bins"))


@query(
    "grid_validity",
    td.ctes("grid")
    + """SELECT year, count(*) AS cells, count(nullif(value, -9999)) AS valid_cells, min(nullif(value, -9999)) AS min_value,
  max(nullif(value, -9999)) AS max_value, count(nullif(value, -9999)) > 0
  AND min(nullif(value, -9999)) < max(nullif(value, -9999)) AS valid FROM grid GROUP BY year""",
)
def grid_validity(spark, sf):
    return zn.grid_validity(td.view(spark, sf, "grid"), ["year"])


@query("clip_cells", td.ctes("grid") + " SELECT x, y, value FROM grid WHERE x >= 0 AND x <= 50000 AND y >= 2000 AND y <= 5000")
def clip_cells(spark, sf):
    return zn.clip_cells(td.view(spark, sf, "grid"), 0, 2000, 50000, 5000).select("x", "y", "value")


@query("select_time_slice", td.ctes("grid") + " SELECT x, y, value FROM grid WHERE year = 1998")
def select_time_slice(spark, sf):
    return zn.select_time_slice(td.view(spark, sf, "grid"), 1998).select("x", "y", "value")


@query(
    "mask_and_orient_grid",
    td.ctes("grid")
    + """SELECT x, y, 8 - row_no AS row_no, layer, nullif(value, -9999) AS value FROM grid
WHERE x >= 1000 AND x <= 60000 AND y >= 2000 AND y <= 6000""",
)
def mask_and_orient_grid(spark, sf):
    oriented = zn.mask_and_orient_grid(td.view(spark, sf, "grid"), 7, (1000, 60000, 2000, 6000))
    return oriented.select("x", "y", "row_no", "layer", "value")


@query(
    "chain_full_join",
    td.ctes("cells")
    + """, a AS (SELECT divide_id, max(value) AS "mean.slope" FROM cells WHERE cell_j < 4 GROUP BY 1),
b AS (SELECT divide_id, min(value) AS "mode.ISLTYP" FROM cells WHERE cell_j > 5 GROUP BY 1),
g AS (SELECT divide_id, max(weight) AS "mean.Coeff" FROM cells WHERE cell_i < 5 GROUP BY 1)
SELECT coalesce(a.divide_id, b.divide_id, g.divide_id) AS divide_id, "mean.slope", "mode.ISLTYP",
  coalesce("mean.Coeff", 0.05) AS "mean.Coeff", 'gl' AS vpuid, 0::DOUBLE AS "mean.impervious"
FROM a FULL JOIN b ON a.divide_id = b.divide_id FULL JOIN g ON g.divide_id = coalesce(a.divide_id, b.divide_id)""",
)
def chain_full_join(spark, sf):
    c = cells(spark, sf)
    slope = c.where("cell_j < 4").groupBy("divide_id").agg(F.max("value").alias("mean.slope"))
    soil = c.where("cell_j > 5").groupBy("divide_id").agg(F.min("value").alias("mode.ISLTYP"))
    ground = c.where("cell_i < 5").groupBy("divide_id").agg(F.max("weight").alias("mean.Coeff"))
    return zn.chain_full_join([slope, soil, ground], "gl")


def bucket_weights(spark, sf):
    return td.driver_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("i_index"),
        F.col("l_linenumber").cast("bigint").alias("j_index"),
        (F.col("l_orderkey") % 500).alias("IDmask"),
        F.col("l_quantity").alias("weight"),
    )


def catchment_mask(spark, sf):
    """A label per grid cell, row 1 at the top; part of the grid lies in no catchment."""
    grid = td.view(spark, sf, "grid").select("col_no", "row_no").distinct()
    return grid.withColumn("cat_id", (F.col("col_no") * 3 + F.col("row_no")) % 6)


_GW = """WITH w AS (SELECT l_suppkey AS i_index, CAST(l_linenumber AS BIGINT) AS j_index, l_orderkey % 500 AS "IDmask",
  l_quantity AS weight FROM lineitem),
mask AS (SELECT DISTINCT l_suppkey AS col_no, CAST(l_linenumber AS BIGINT) AS row_no,
  (l_suppkey * 3 + l_linenumber) % 6 AS cat_id FROM lineitem),
j AS (SELECT w.*, m.cat_id FROM w LEFT JOIN mask m ON m.col_no = w.i_index AND 8 - m.row_no = w.j_index AND m.cat_id > 0),
s AS (SELECT "IDmask", cat_id, sum(weight) AS sumwt FROM j GROUP BY 1, 2),
top AS (SELECT *, max(sumwt) OVER (PARTITION BY "IDmask") AS m FROM s),
cross_walk AS (SELECT "IDmask" AS "ComID", cat_id, sumwt FROM top WHERE sumwt = m AND cat_id IS NOT NULL)
"""


def _crosswalk(spark, sf):
    joined = zn.grid_weight_join(bucket_weights(spark, sf), catchment_mask(spark, sf), 7)
    return zn.dominant_catchment(zn.weights_by_catchment(joined))


@query("grid_weight_join", _GW + 'SELECT i_index, j_index, "IDmask", weight, cat_id FROM j')
def grid_weight_join(spark, sf):
    return zn.grid_weight_join(bucket_weights(spark, sf), catchment_mask(spark, sf), 7)


@query("weights_by_catchment", _GW + 'SELECT "IDmask", cat_id, sumwt FROM s')
def weights_by_catchment(spark, sf):
    return zn.weights_by_catchment(zn.grid_weight_join(bucket_weights(spark, sf), catchment_mask(spark, sf), 7))


@query("dominant_catchment", _GW + 'SELECT "ComID", cat_id, sumwt FROM cross_walk')
def dominant_catchment(spark, sf):
    return _crosswalk(spark, sf)


@query(
    "gw_weighted_mean",
    _GW
    + """SELECT 'cat-' || x.cat_id AS divide_id, 'gage-' || (x.cat_id % 3) AS gage,
  round(sum((1 + p.p_size) / 100.0::DOUBLE * sumwt) / sum(sumwt), 6) AS "Cgw",
  round(sum(p.p_size % 6 * sumwt) / sum(sumwt), 6) AS expon,
  round(sum(p.p_retailprice * sumwt) / sum(sumwt) / 1000, 6) AS max_gw_storage
FROM cross_walk x JOIN part p ON p.p_partkey = x."ComID" GROUP BY 1, 2""",
)
def gw_weighted_mean(spark, sf):
    part = td.driver_table(spark, sf, "part")
    buckets = part.select(
        F.col("p_partkey").alias("ComID"),
        ((F.col("p_size") + 1) / 100.0).alias("Coeff"),
        (F.col("p_size") % 6).cast("double").alias("Expon"),
        F.col("p_retailprice").alias("Zmax"),
    )
    catchments = catchment_mask(spark, sf).select("cat_id").distinct().select(
        "cat_id",
        F.concat(F.lit("cat-"), "cat_id").alias("divide_id"),
        F.concat(F.lit("gage-"), (F.col("cat_id") % 3).cast("string")).alias("gage"),
    )
    return rounded(zn.gw_weighted_mean(buckets, _crosswalk(spark, sf), catchments))
