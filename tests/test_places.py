"""Rectangles that meet, sections in the order of their places, and references between layers, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillflow import sinks
from rillflow.operators import subset, xs

BOX = "min_x double, min_y double, max_x double, max_y double"


def boxes(seed, n, sizes):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        x, y, w, h = draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice(sizes) * draw.random(), draw.choice(sizes) * draw.random()
        out.append((x, y, x + w, y + h))
    return out


def meets(a, b):
    return a[2] >= b[0] and a[0] <= b[2] and a[3] >= b[1] and a[1] <= b[3]


@pytest.mark.parametrize("seed", [1, 2])
def test_rectangles_of_all_sizes_meet_once(spark, seed):
    few = boxes(seed, 40, [0.01, 1, 20, 300]) + [(0.0, 0.0, 8.0, 8.0), (8.0, 8.0, 8.0, 8.0), (-1e6, -1e6, 1e6, 1e6)]
    many = boxes(seed + 9, 300, [0.001, 0.5, 3, 64]) + [(8.0, 8.0, 16.0, 16.0), (16.0, 0.0, 17.0, 16.0), (8.0, 8.0, 8.0, 8.0)]
    left = spark.createDataFrame([(i, *b) for i, b in enumerate(few)] + [(-1, None, 0.0, 1.0, 1.0)], f"i int, {BOX}")
    right = spark.createDataFrame([(j, *b) for j, b in enumerate(many)] + [(-1, 0.0, 0.0, None, 1.0)], f"j int, {BOX}")
    got = Counter((r.i, r.j) for r in xs.meeting_rectangles(left, right, ["i"]).collect())
    assert got == Counter((i, j) for i, a in enumerate(few) for j, b in enumerate(many) if meets(a, b))


def test_reference_in_the_extent_of_all_and_of_each_group(spark):
    sections = [(g, *b) for g, b in zip("aabbc", boxes(3, 5, [1]), strict=True)]
    reference = [(f"r{j}", j / 2, *b) for j, b in enumerate(boxes(4, 80, [30]))]
    frame = spark.createDataFrame(sections, f"domain string, {BOX}")
    rivers = spark.createDataFrame(reference, f"flowpath_id string, lengthkm double, {BOX}")
    span = lambda rows: (min(r[1] for r in rows), min(r[2] for r in rows), max(r[3] for r in rows), max(r[4] for r in rows))
    got = xs.reference_in_extent(frame, rivers)
    assert got.columns == rivers.columns
    assert {r.flowpath_id for r in got.collect()} == {r[0] for r in reference if meets(span(sections), r[2:])}
    each = {(r.domain, r.flowpath_id) for r in xs.reference_in_extent(frame, rivers, ["domain"]).collect()}
    assert each == {(d, r[0]) for d in "abc" for r in reference if meets(span([s for s in sections if s[0] == d]), r[2:])}
    assert xs.reference_in_extent(frame.limit(0), rivers).count() == 0
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def rows_scanned(df):
    """Rows that the scan hands on: those of the row groups that its filters do not rule out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_box_reads_few_row_groups_of_sections_written_by_place(spark, shared):
    n = 40_000
    draw = F.rand(7), F.rand(8)
    sections = spark.range(n).select("id", (draw[0] * 100).alias("min_x"), (draw[1] * 100).alias("min_y"))
    sections = sections.withColumns({"max_x": F.col("min_x") + 0.1, "max_y": F.col("min_y") + 0.1})
    sections.write.parquet(f"{shared}/plain")
    plain = spark.read.parquet(f"{shared}/plain")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_xs_by_place(plain, f"{shared}/placed", row_group_bytes=64 << 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    placed = spark.read.parquet(f"{shared}/placed")
    box = (20, 30, 30, 42)
    found, want = (sorted(r.id for r in xs.xs_within_bbox(t, *box).collect()) for t in (placed, plain))
    assert found == want and 300 < len(want) < 600
    assert rows_scanned(xs.xs_within_bbox(plain, *box)) == n
    assert rows_scanned(xs.xs_within_bbox(placed, *box)) < n / 5


def test_place_code_alternates_the_bits(spark):
    code = sinks.place_code(F.col("x"), F.col("y"), (0.0, 0.0, 65_535.0, 65_535.0))
    rows = [(0.0, 0.0), (65_535.0, 65_535.0), (1.0, 0.0), (0.0, 1.0), (5.0, 3.0), (40_000.0, 123.0), (-9.0, 1e9)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, y double").select(code).collect()]
    clamp = lambda v: int(min(max(v, 0), 65_535))
    assert got == [sum((clamp(x) >> i & 1) << 2 * i | (clamp(y) >> i & 1) << 2 * i + 1 for i in range(16)) for x, y in rows]


def test_sections_at_one_spot_and_none(spark, shared):
    one = spark.range(50).select("id", *[F.lit(3.0).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    sinks.write_xs_by_place(one, f"{shared}/one")
    assert spark.read.parquet(f"{shared}/one").count() == 50
    sinks.write_xs_by_place(one.limit(0), f"{shared}/none")
    assert spark.read.parquet(f"{shared}/none").count() == 0


def test_broken_references_are_counted_by_distinct_key(spark):
    layers = {
        "network": spark.createDataFrame([("wb-1", "cat-1", 5.0, "01"), ("wb-2", None, None, "01"), ("wb-9", "cat-9", 6.0, "02"), ("nex-1", None, None, "01"), (None, None, None, None)], "id string, divide_id string, poi_id double, vpuid string"),
        "flowpaths": spark.createDataFrame([("wb-1", "nex-1", "cat-1"), ("wb-2", "nex-2", "cat-2"), ("wb-2", "nex-3", "cat-2"), ("wb-3", None, None)], "id string, toid string, divide_id string"),
        "nexus": spark.createDataFrame([("nex-1",), ("nex-8",)], "id string"),
        "divides": spark.createDataFrame([("cat-1",), ("cat-7",), ("cat-7",)], "divide_id string"),
        "pois": spark.createDataFrame([(5,), (7,), (8,)], "poi_id int"),
    }
    got = {r.check: r.violations for r in subset.check_relationships(layers).collect()}
    assert got == {
        "flowpaths.id in network": 1, "network flowpath in flowpaths": 1, "flowpaths.toid in nexus": 2, "flowpaths.divide_id in divides": 1,
        "divides.divide_id in network": 1, "pois in network": 2, "single VPU": 1,
    }
