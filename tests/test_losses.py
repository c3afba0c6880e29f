"""Inputs that used to lose rows, columns or precision."""

import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rillflow.functions import times
from rillflow.functions.geo import _polygon_rings
from rillflow.operators import versions, zonal
from rillflow.sources import files, tables


def test_marked_table_of_seventy_columns(spark, tmp_path):
    names = [f"h{i}" for i in range(70)]
    (tmp_path / "a.csv").write_text("x\n#SERIES DATA#\n" + ",".join(names) + '\n"1,5",' + ",".join(str(i) for i in range(1, 70)) + "\n")
    row = files.read_marked_csv(spark, str(tmp_path), {"h0": "string", "h63": "double", "h69": "double"}).first()
    assert (row.h0, row.h63, row.h69) == ("1,5", 63.0, 69.0)
    with pytest.raises(PySparkException, match="no column h70"):
        files.read_marked_csv(spark, str(tmp_path), {"h70": "double"}).collect()


def test_collection_has_columns_of_every_file(spark, shared):
    spark.range(2).write.parquet(f"{shared}/c/v=1")
    spark.range(2).withColumn("extra", F.lit(5)).write.parquet(f"{shared}/c/v=2")
    rows = tables.read_partitioned_collection(spark, f"{shared}/c", r"v=(\d)", "v").select("id", "extra", "v").collect()
    assert sorted((r.v, r.extra) for r in rows) == sorted([("1", None)] * 2 + [("2", 5)] * 2, key=str)


def square(code, dims, order="<", srid=False):
    points = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    body = b"".join(struct.pack(f"{order}{dims}d", *p, *[9.0] * (dims - 2)) for p in points)
    head = struct.pack(f"{order}BI", 1 if order == "<" else 0, code) + (struct.pack(f"{order}I", 5070) if srid else b"")
    return head + struct.pack(f"{order}II", 1, 5) + body


@pytest.mark.parametrize("wkb", [square(3, 2), square(1003, 3), square(2003, 3), square(3003, 4), square(0xA0000003, 3, srid=True), square(3, 2, ">")])
def test_polygons_with_more_dimensions(wkb):
    (ring,) = _polygon_rings(wkb)
    assert ring.tolist() == [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]


def test_repeated_cells_and_cells_outside_stay(spark):
    polygons = spark.createDataFrame([(7, square(1003, 3), 0.0, 0.0, 4.0, 4.0)], "cat_id bigint, geometry binary, min_x double, min_y double, max_x double, max_y double")
    cells = spark.createDataFrame([(1.0, 1.0, "a")] * 2 + [(9.0, 9.0, "b")], "x double, y double, v string")
    assert [r.cat_id for r in zonal.cells_in_polygons(cells, polygons).collect()] == [7, 7]
    both = zonal.cells_in_polygons(cells, polygons, outside=True).collect()
    assert sorted((r.v, r.cat_id) for r in both) == [("a", 7), ("a", 7), ("b", None)]


def test_times_without_seconds_and_text_that_is_none(spark):
    df = spark.createDataFrame([("2024-01-01T01:00Z",), ("2024-01-01T01:00+02:00",), (None,)], "t string")
    got = [str(r[0]) for r in df.select(times.to_naive_utc(F.col("t"))).collect()]
    assert got == ["2024-01-01 01:00:00", "2023-12-31 23:00:00", "None"]
    with pytest.raises(PySparkException, match="no time: soon"):
        spark.createDataFrame([("soon",)], "t string").select(times.to_naive_utc(F.col("t"))).collect()


def test_snapshots_keep_a_batch_column_and_refuse_other_types(spark, shared):
    versions.append_snapshot(spark.range(100, 103).select(F.col("id").alias("batch"), F.lit(1).alias("n")), f"{shared}/t")
    assert sorted(r.batch for r in versions.as_of(spark, f"{shared}/t").collect()) == [100, 101, 102]
    with pytest.raises(ValueError, match="n is int, not bigint"):
        versions.append_snapshot(spark.range(1).select(F.col("id").alias("batch"), F.lit(1).cast("long").alias("n")), f"{shared}/t")
    with pytest.raises(ValueError, match="reserved"):
        versions.append_snapshot(spark.range(1).withColumnRenamed("id", "rillflow_batch"), f"{shared}/t")
