"""Polygons on rasters, against clipping and ray casting one by one."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rillflow.operators import coverage, zonal


def wkb(rings):
    body = b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[c for p in r for c in p]) for r in rings)
    return struct.pack("<BII", 1, 3, len(rings)) + body


def multi(polygons):
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(wkb, polygons))


def star(draw, x, y, size, points=9, turn=1):
    radii = [size * draw.uniform(0.4, 1) for _ in range(points)]
    ring = [(x + r * math.cos(turn * 2 * math.pi * k / points), y + r * math.sin(turn * 2 * math.pi * k / points)) for k, r in enumerate(radii)]
    return [*ring, ring[0]]


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def clipped_area(ring, x0, y0, x1, y1):
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            ina, inb = keep * (a[axis] - bound) >= 0, keep * (b[axis] - bound) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(bound if i == axis else a[i] + t * (b[i] - a[i]) for i in (0, 1)))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def shapes():
    """By cat_id: the polygons, each its outer ring and its holes."""
    draw = random.Random(5)
    out = {k: [[star(draw, draw.uniform(-40, 40), draw.uniform(-40, 40), draw.choice([0.3, 3, 17]), turn=draw.choice([1, -1]))]] for k in range(12)}
    out[20] = [[star(draw, 0, 0, 90, 24, 1), box(-3, -3, 5, 6), box(10, 10, 2.5, 2.5)[::-1]]]
    out[21] = [[box(4, 4, 6, 8)], [box(20, -8, 2, 2), box(20.5, -7.5, 1, 1)]]
    out[22] = [[box(-2, -2, 4, 2)[::-1]]]
    out[23] = [[[(0, 0), (7, 7), (14, 0), (0, 0)]]]
    return out


GEOMETRY = "cat_id bigint, geometry binary"


def frame(spark, polygons):
    return spark.createDataFrame([(k, multi(v) if len(v) > 1 else wkb(v[0])) for k, v in polygons.items()] + [(99, None)], GEOMETRY)


@pytest.mark.parametrize("grid", [coverage.Grid(0.0, 0.0, 2.0, 2.0), coverage.Grid(-1.25, 7.5, 1.5, 4.0)])
def test_shares_equal_clipping(spark, grid):
    polygons = shapes()
    spans = coverage.cell_shares(frame(spark, polygons), grid).collect()
    got = {(s.cat_id, s.row, c): s.share for s in spans for c in range(s.first_col, s.last_col + 1)}
    assert len(got) == sum(s.last_col - s.first_col + 1 for s in spans)
    cell = grid.width * grid.height
    for cat, parts in polygons.items():
        xs, ys = zip(*[p for part in parts for ring in part for p in ring], strict=True)
        for row in range(math.floor((min(ys) - grid.y) / grid.height) - 1, math.ceil((max(ys) - grid.y) / grid.height) + 1):
            for col in range(math.floor((min(xs) - grid.x) / grid.width) - 1, math.ceil((max(xs) - grid.x) / grid.width) + 1):
                edges = (grid.x + col * grid.width, grid.y + row * grid.height, grid.x + (col + 1) * grid.width, grid.y + (row + 1) * grid.height)
                want = sum((-1 if k else 1) * clipped_area(ring[:-1], *edges) for part in parts for k, ring in enumerate(part)) / cell
                assert got.get((cat, row, col), 0.0) == pytest.approx(want, abs=1e-9), (cat, row, col)
    wide = [s for s in spans if s.cat_id == 20]
    assert len(wide) < 0.5 * sum(s.last_col - s.first_col + 1 for s in wide)


def test_weights_of_cells_follow_from_outlines(spark):
    cells = spark.createDataFrame([(0, 0, 10.0, "a"), (0, 1, 20.0, "b"), (1, 0, 30.0, "c"), (1, 0, 50.0, "again"), (9, 9, 1.0, "off")], "row bigint, col bigint, value double, name string")
    shares = coverage.cell_shares(spark.createDataFrame([(7, wkb([box(0.5, 0.0, 1.0, 1.25)]))], GEOMETRY), coverage.Grid(0.0, 0.0, 1.0, 1.0))
    found = coverage.covered_cells(cells, shares)
    assert sorted((r.name, r.cat_id, r.weight) for r in found.collect()) == [("a", 7, 0.5), ("again", 7, 0.125), ("b", 7, 0.5), ("c", 7, 0.125)]
    mean = zonal.zonal(found.withColumnRenamed("cat_id", "divide_id"), "mean").collect()
    assert [(r[0], r[1]) for r in mean] == [(7, pytest.approx((5 + 10 + 3.75 + 6.25) / 1.25))]


def inside(x, y, parts):
    hit = False
    for part in parts:
        for ring in part:
            for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    hit = not hit
    return hit


@pytest.mark.parametrize("regular", [True, False])
def test_cells_equal_ray_casting(spark, regular):
    """A raster, and points of any place; one polygon holds most of them, another nearly none, far outside ones are cut off."""
    draw = random.Random(2)
    polygons = shapes() | {30: [[box(-1e7, -1e7, 2e7, 2e7), box(-60, -60, 50, 50)]], 31: [[box(500, 500, 3, 3)]]}
    polygons = {(-k if k == 30 else k): v for k, v in polygons.items()}
    points = [(float(x), float(y)) for x in range(-60, 60, 3) for y in range(-60, 60, 2)] if regular else [(draw.uniform(-70, 70), draw.uniform(-70, 70)) for _ in range(1500)]
    points += [points[0]] * 300
    cells = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, x double, y double").repartition(5)
    found = {r.k: r.cat_id for r in zonal.cells_in_polygons(cells, frame(spark, polygons)).collect()}
    want = {k: max((c for c, parts in polygons.items() if inside(*p, parts)), default=None) for k, p in enumerate(points)}
    assert found == {k: v for k, v in want.items() if v is not None}
    both = zonal.cells_in_polygons(cells, frame(spark, polygons), outside=True)
    assert {r.k: r.cat_id for r in both.collect()} == want


def test_no_cells_one_cell_and_no_polygons(spark):
    shape = frame(spark, {1: [[box(0, 0, 2, 2)]]})
    none = spark.createDataFrame([], "x double, y double")
    one = spark.createDataFrame([(1.0, 1.0), (None, 1.0)], "x double, y double")
    assert zonal.cells_in_polygons(none, shape).count() == 0
    assert [r.cat_id for r in zonal.cells_in_polygons(one, shape).collect()] == [1]
    assert sorted(str(r.cat_id) for r in zonal.cells_in_polygons(one, shape, outside=True).collect()) == ["1", "None"]
    assert zonal.cells_in_polygons(one, shape.where("cat_id = 99")).count() == 0
    assert coverage.cell_shares(shape.where("cat_id = 99"), coverage.Grid(0.0, 0.0, 1.0, 1.0)).count() == 0


def test_a_polygon_of_the_whole_domain_makes_no_large_task(spark):
    """Stretches meet cells by row and block: no block holds more than a few times the mean."""
    cells = spark.range(40_000).select((F.col("id") % 400).cast("double").alias("x"), F.floor(F.col("id") / 400).cast("double").alias("y"))
    rows = cells.select("y").distinct()
    polygons = spark.createDataFrame([(0, wkb([box(-1e6, -1e6, 2e6, 2e6)]))] + [(k, wkb([box(k * 4.0, k, 3, 3)])) for k in range(1, 90)], GEOMETRY)
    spans = coverage.centre_spans(polygons, rows, 0.0, 99.0)
    assert spans.where("cat_id = 0").count() == 100
    assert zonal.cells_in_polygons(cells, polygons).where("cat_id = 0").count() == 40_000 - sum(len({(x, y) for x in range(k * 4, min(k * 4 + 3, 400)) for y in range(k, min(k + 3, 100))}) for k in range(1, 90))


def test_values_at_one_place_meet_a_divide_once(spark):
    values = [(r, c, v) for r in range(2) for c in range(3) for v in (1.0 + r, 5.0 * c, float("nan"), None)] + [(0, 5, None)]
    cells = spark.createDataFrame(values, "row long, col long, value double")
    shares = spark.createDataFrame([(1, 0, 0, 2, 0.5), (1, 1, 1, 1, 1.0), (2, 0, 5, 5, 1.0)], "cat_id long, row long, first_col long, last_col long, share double")

    def mean(found):
        return {r.divide_id: r.v for r in zonal.zonal(found.withColumnRenamed("cat_id", "divide_id"), "mean", "value", "v").collect()}

    each = coverage.covered_cells(cells, shares)
    merged = coverage.covered_cells(zonal.merged_cells(cells, ["row", "col"]), shares)
    assert each.count() == 17 and merged.count() == 5
    assert mean(merged.withColumn("weight", F.col("weight") * F.col("n"))) == pytest.approx(mean(each))


def test_outlines_of_one_file_are_cut_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(coverage, "PER_TASK", 10)
    polygons = spark.createDataFrame([(i, wkb([box(i + 0.5, 0.5, 20, 20)])) for i in range(3)], "cat_id long, geometry binary").coalesce(1)
    shares = coverage.cell_shares(polygons, coverage.Grid(0.0, 0.0, 1.0, 1.0))
    assert shares.rdd.getNumPartitions() >= 12
    area = F.sum((F.col("last_col") - F.col("first_col") + 1) * F.col("share"))
    assert [r.a for r in shares.groupBy("cat_id").agg(area.alias("a")).collect()] == pytest.approx([400.0] * 3)
    rows = spark.range(30).select((F.col("id") + 0.5).alias("y"))
    spans = coverage.centre_spans(polygons, rows, 0.5, 29.5)
    assert "REPARTITION_BY_NUM" in spans._jdf.queryExecution().executedPlan().toString() and spans.count() == 60
