"""Polygons on a raster, by their edges.

Edges are rows, so a polygon as large as the domain, or with a very long outline, is spread like many small ones. What a
row of cells crosses gives spans of cells, and only spans are joined with cells: the work grows with the outlines and with
the cells, not with the product of polygons and cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.geo import polygon_edges
from rillflow.plans.graph import within
from rillflow.plans.workspace import materialize

#: Cells and rows of cells that a block has, on average.
PER_BLOCK = 64
#: Pieces of outlines that one task cuts and sums, about.
PER_TASK = 500_000
#: Shares are known to this many decimals.
DIGITS = 12


def edges_of(polygons: DataFrame) -> DataFrame:
    """``(cat_id, ax, ay, bx, by)``: a row for each edge that is not level, the polygon on its left."""
    each = polygons.select("cat_id", F.explode(polygon_edges("geometry")).alias("e")).select("cat_id", "e.*")
    return each.where("ay <> by")


def _tasks(pieces: Column, edges: DataFrame) -> int:
    """How many tasks share the work on ``edges``, an edge counting by the ``pieces`` that it is cut into."""
    total = edges.agg(F.sum(pieces)).first()[0] or 0
    return max(edges.sparkSession.sparkContext.defaultParallelism, math.ceil(total / PER_TASK))


def centre_spans(polygons: DataFrame, rows: DataFrame, first: float, last: float) -> DataFrame:
    """``(cat_id, y, x_from, x_to)``: for every row of cell centres, the stretches that lie in a polygon (even-odd rule).

    ``rows`` has the distinct ``y``, from ``first`` to ``last``. A centre on the left end of a stretch is inside, one on
    the right end is not. The few edges that cross one row are put in order together.
    """
    height = (last - first) * PER_BLOCK / max(rows.count(), 1) or 1.0
    edges = edges_of(polygons).withColumns({"low": F.greatest(F.least("ay", "by"), F.lit(first)), "high": F.least(F.greatest("ay", "by"), F.lit(last + height))})
    edges = materialize(edges.where("low < high"), "edges")
    # few polygons lie in few files, but their edges are dealt out before they are cut by rows
    edges = edges.repartition(_tasks((F.col("high") - F.col("low")) * (PER_BLOCK / height) + 1, edges), "cat_id", "ax", "ay", "bx", "by")
    met = within(edges, rows.select("y"), "y", "low", "high", block=height, keep=True).where(F.col("y") < F.col("high"))
    at = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    lists = met.groupBy("cat_id", "y").agg(F.sort_array(F.collect_list(at)).alias("x"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda i: F.struct(F.get("x", 2 * i).alias("x_from"), F.get("x", 2 * i + 1).alias("x_to")))
    spans = lists.where(F.size("x") > 1).select("cat_id", "y", F.explode(pairs).alias("s"))
    return spans.select("cat_id", "y", "s.*").where("x_from < x_to")


@dataclass(frozen=True)
class Grid:
    """A raster: the outer corner of the cell at row 0 and column 0, and the width and height of a cell."""

    x: float
    y: float
    width: float
    height: float


def cell_shares(polygons: DataFrame, grid: Grid) -> DataFrame:
    """``(cat_id, row, first_col, last_col, share)``: what part of each cell a polygon covers, above 0.

    Cells that an outline crosses have a row each, those between them that a polygon covers alike one row together. An
    edge counts for the cells right of it, by the height it rises in their row, and for its own cell by what lies right of
    it there; sums along a row of cells give the covered part. Polygons that touch nothing of a cell have no row for it.
    """
    scaled = edges_of(polygons).select(
        "cat_id",
        *[((F.col(c) - o) / w).alias(n) for c, o, w, n in (("ax", grid.x, grid.width, "u1"), ("ay", grid.y, grid.height, "v1"), ("bx", grid.x, grid.width, "u2"), ("by", grid.y, grid.height, "v2"))],
    ).where("v1 <> v2")
    scaled = materialize(scaled, "edges")
    # few polygons lie in few files, but their edges are dealt out before they are cut, and so are the rows of cells
    tasks = _tasks(F.abs(F.col("v2") - F.col("v1")) + F.abs(F.col("u2") - F.col("u1")) + 2, scaled)
    scaled = scaled.repartition(tasks, "cat_id", "u1", "v1", "u2", "v2")
    rising = F.col("v2") > F.col("v1")
    up = scaled.select(
        "cat_id",
        F.when(rising, 1.0).otherwise(-1.0).alias("sign"),
        *[F.when(rising, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("u1", "u2", "u1"), ("v1", "v2", "v1"), ("u2", "u1", "u2"), ("v2", "v1", "v2"))],
    )
    # the part of an edge in each row of cells, and of that in each cell
    last_row = F.greatest(F.ceil("v2") - 1, F.floor("v1"))
    in_row = up.withColumn("row", F.explode(F.sequence(F.floor("v1"), last_row))).repartition(tasks, "cat_id", "row")
    in_row = in_row.withColumns({"low": F.greatest(F.col("v1"), F.col("row").cast("double")), "high": F.least(F.col("v2"), F.col("row") + F.lit(1.0))})

    def u_at(v: str) -> Column:
        straight = F.col("u1") + (F.col("u2") - F.col("u1")) * (F.col(v) - F.col("v1")) / (F.col("v2") - F.col("v1"))
        return F.when(F.col(v) == F.col("v2"), F.col("u2")).otherwise(straight)

    in_row = in_row.select("cat_id", "sign", "row", (F.col("high") - F.col("low")).alias("rise"), u_at("low").alias("a"), u_at("high").alias("b"))
    in_row = in_row.withColumns({"left": F.least("a", "b"), "right": F.greatest("a", "b")})
    last_col = F.greatest(F.ceil("right") - 1, F.floor("left"))
    in_cell = in_row.withColumn("col", F.explode(F.sequence(F.floor("left"), last_col)))
    one = F.greatest(F.col("left"), F.col("col").cast("double"))
    two = F.least(F.col("right"), F.col("col") + F.lit(1.0))
    part = F.when(F.col("left") == F.col("right"), F.col("rise")).otherwise(F.col("rise") * (two - one) / (F.col("right") - F.col("left")))
    in_cell = in_cell.select("cat_id", "row", "col", (-F.col("sign") * part).alias("rise"), (F.col("col") + 1 - (one + two) / 2).alias("beside"))
    sums = in_cell.groupBy("cat_id", "row", "col").agg(F.sum("rise").alias("rise"), F.sum(F.col("rise") * F.col("beside")).alias("own"))

    along = Window.partitionBy("cat_id", "row").orderBy("col")
    through = F.sum("rise").over(along.rowsBetween(Window.unboundedPreceding, 0))
    known = sums.select("cat_id", "row", "col", through.alias("after"), (through - F.col("rise") + F.col("own")).alias("own"), F.lead("col").over(along).alias("next"))
    span = lambda first, last, share: F.struct(first.alias("first_col"), last.alias("last_col"), F.round(share, DIGITS).alias("share"))
    here = span(F.col("col"), F.col("col"), F.col("own"))
    between = span(F.col("col") + 1, F.col("next") - 1, F.col("after"))
    spans = known.select("cat_id", "row", F.explode(F.array(here, between)).alias("s")).select("cat_id", "row", "s.*")
    return spans.where("last_col >= first_col and share > 0")


def covered_cells(cells: DataFrame, shares: DataFrame) -> DataFrame:
    """``(cell columns, cat_id, weight)``: the cells (``row``, ``col``) of each polygon with the share of them it covers."""
    found = within(shares, cells, "col", "first_col", "last_col", ("row",), block=PER_BLOCK, keep=True)
    return found.select(*[F.col(f"`{c}`") for c in cells.columns], "cat_id", F.col("share").alias("weight"))
