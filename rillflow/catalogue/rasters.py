"""Queries on polygons and rasters: cells inside, shares of cells covered, statistics weighted by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.catalogue import testdata as td
from rillflow.catalogue.registry import query
from rillflow.catalogue.series import _DIAMONDS_SQL, diamond_outline, diamonds
from rillflow.operators import coverage as cov
from rillflow.operators import zonal as zn
from rillflow.plans.workspace import materialize

#: A diamond as wide as the domain, in which the others lie.
_DOMAIN = (0, 48_000.0, 4_000.0, 60_000.0)
_WITH_DOMAIN = _DIAMONDS_SQL + ", shapes AS (SELECT * FROM poly UNION ALL SELECT {}, {}, {}, {})".format(*_DOMAIN)


def with_domain(spark, sf):
    cat_id, x, y, r = _DOMAIN
    domain = spark.range(1).select(F.lit(cat_id).cast("bigint").alias("cat_id"), diamond_outline(F.lit(x), F.lit(y), F.lit(r)).alias("geometry"))
    return materialize(diamonds(spark, sf).unionByName(domain), "polygons")


@query(
    "cells_in_polygons_domain",
    _WITH_DOMAIN
    + """, c AS (SELECT l_orderkey, l_linenumber, l_suppkey * 1000 + l_quantity * 10 AS x, l_linenumber * 1000 + l_discount * 1000 AS y FROM lineitem),
spots AS (SELECT DISTINCT x, y FROM c),
inside AS (SELECT s.x, s.y, max(p.cat_id) AS cat_id FROM spots s JOIN shapes p
  ON s.x BETWEEN p.cx - p.r AND p.cx + p.r AND abs(s.x - p.cx) + abs(s.y - p.cy) < p.r GROUP BY s.x, s.y)
SELECT l_orderkey, l_linenumber, cat_id FROM c JOIN inside USING (x, y)""",
)
def cells_in_polygons_domain(spark, sf):
    """One polygon holds nearly all cells, thousands of others hold some of them."""
    items = td.driver_table(spark, sf, "lineitem")
    x = (F.col("l_suppkey") * 1000 + F.col("l_quantity") * 10).cast("double")
    y = (F.col("l_linenumber") * 1000 + F.col("l_discount") * 1000).cast("double")
    cells = items.select("l_orderkey", "l_linenumber", x.alias("x"), y.alias("y"))
    return zn.cells_in_polygons(cells, with_domain(spark, sf)).select("l_orderkey", "l_linenumber", "cat_id")


_GRID = cov.Grid(0.0, 0.0, 1000.0, 1000.0)

# The area of a diamond left of and below a point, by the point's place from the centre (a, b), within the radius.
_SHARES = (
    _DIAMONDS_SQL
    + """, boxes AS (SELECT *, unnest(range(floor((cy - r) / 1000)::BIGINT, floor((cy + r) / 1000)::BIGINT + 1)) AS row FROM poly),
cells AS (SELECT *, unnest(range(floor((cx - r) / 1000)::BIGINT, floor((cx + r) / 1000)::BIGINT + 1)) AS col FROM boxes),
corners AS (SELECT cat_id, row, col, r, unnest([
    {'s': 1, 'a': (col + 1) * 1000 - cx, 'b': (row + 1) * 1000 - cy}, {'s': -1, 'a': col * 1000 - cx, 'b': (row + 1) * 1000 - cy},
    {'s': -1, 'a': (col + 1) * 1000 - cx, 'b': row * 1000 - cy}, {'s': 1, 'a': col * 1000 - cx, 'b': row * 1000 - cy}]) AS k FROM cells),
near AS (SELECT cat_id, row, col, r, k.s AS s, greatest(least(k.a, r), -r) AS a, greatest(least(k.b, r), -r) AS b FROM corners),
halves AS (SELECT *, unnest([{'w': s, 'h': r}, {'w': CASE WHEN a >= 0 THEN s ELSE -s END, 'h': abs(a)}]) AS p FROM near),
parts AS (SELECT cat_id, row, col, r, b, p.w AS w, p.h AS h, least(p.h, r - abs(b)) AS m FROM halves),
areas AS (SELECT cat_id, row, col, sum(w * ((b + r) * m - m * m / 2
    + CASE WHEN b >= 0 THEN 2 * r * h - h * h - 2 * r * m + m * m ELSE 0 END)) / 1000000 AS share FROM parts GROUP BY ALL),
shares AS (SELECT cat_id, row, col, share FROM areas WHERE round(share, 6) > 0)"""
)


def shares(spark, sf):
    return cov.cell_shares(materialize(diamonds(spark, sf), "polygons"), _GRID)


@query("cell_shares", _SHARES + " SELECT cat_id, row, col, round(share, 6) AS share FROM shares")
def cell_shares(spark, sf):
    cells = shares(spark, sf).withColumn("col", F.explode(F.sequence("first_col", "last_col")))
    return cells.select("cat_id", "row", "col", F.round("share", 6).alias("share")).where("share > 0")


@query("covered_area", _DIAMONDS_SQL + " SELECT cat_id, round(2 * r * r / 1000000, 6) AS area FROM poly")
def covered_area(spark, sf):
    """Shares add up to the area of each polygon."""
    area = F.sum((F.col("last_col") - F.col("first_col") + 1) * F.col("share"))
    return shares(spark, sf).groupBy("cat_id").agg(F.round(area, 6).alias("area"))


@query(
    "zonal_mean_covered",
    _SHARES
    + """, raster AS (SELECT l_linenumber AS row, l_suppkey % 100 AS col, l_extendedprice AS value FROM lineitem)
SELECT cat_id AS divide_id, round(sum(value * share) / sum(share), 4) AS v FROM shares JOIN raster USING (row, col) GROUP BY cat_id""",
)
def zonal_mean_covered(spark, sf):
    """Cells count by the part of them that lies in a catchment, which follows from the outline."""
    items = td.driver_table(spark, sf, "lineitem")
    cells = items.select(F.col("l_linenumber").cast("bigint").alias("row"), (F.col("l_suppkey") % 100).cast("bigint").alias("col"), F.col("l_extendedprice").alias("value"))
    parts = shares(spark, sf).where("round(share, 6) > 0")
    weighted = cov.covered_cells(zn.merged_cells(cells, ["row", "col"]), parts).withColumnRenamed("cat_id", "divide_id")
    weighted = weighted.withColumn("weight", F.col("weight") * F.col("n"))
    return zn.zonal(weighted, "mean", "value", "v").select("divide_id", F.round("v", 4).alias("v"))
