import pytest
from pyspark.sql import functions as F

from rillflow import sinks
from rillflow.catalogue import testdata as td
from rillflow.catalogue.all import QUERIES
from rillflow.operators import series, subset as sub, xs
from rillflow.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layer_scan_prunes_folders_and_columns_and_pushes_filters(spark, shared):
    sinks.write_vpu_partitioned(td.view(spark, SF, "flowpaths"), f"{shared}/conus_hf/flowpaths")
    df = tables.read_layer(spark, shared, "conus_hf", "flowpaths", (F.col("vpuid") == "01") & (F.col("hydroseq") > 5), ["id"])
    text = plan(df)
    assert "PartitionFilters: [isnotnull(vpuid" in text
    assert "GreaterThan(hydroseq,5)" in text
    assert "ReadSchema: struct<id:string,hydroseq:int>" in text


def test_box_and_time_range_reach_the_scan(spark, shared):
    td.view(spark, SF, "xs").write.parquet(f"{shared}/xs")
    text = plan(xs.xs_within_bbox(spark.read.parquet(f"{shared}/xs"), 1, 2, 3, 4).select("flowpath_id"))
    for pushed in ("GreaterThanOrEqual(min_y,1.0)", "GreaterThanOrEqual(min_x,2.0)", "LessThanOrEqual(max_y,3.0)"):
        assert pushed in text
    flow = spark.sql("SELECT 'a' AS id, timestamp_ntz'2024-01-01' AS time, 1D AS q_cms, 2D AS q_cms_denoted_3")
    flow.write.parquet(f"{shared}/flow")
    text = plan(series.streamflow_range(spark.read.parquet(f"{shared}/flow"), "a", "2024-01-01", "2024-01-02"))
    assert "EqualTo(id,a)" in text and "GreaterThanOrEqual(time," in text and "IsNotNull(q_cms)" in text


def test_basin_of_one_gauge_reads_only_its_vpus(spark, shared):
    for name in td.LAYERS:
        sinks.write_vpu_partitioned(td.view(spark, SF, name), f"{shared}/conus_hf/{name}")
    layers = {name: tables.read_layer(spark, shared, "conus_hf", name) for name in td.LAYERS}
    found = sub.subset_hydrofabric(layers, td.graph(spark, SF), ["gages-000010"])
    text = plan(found["flowpaths"])
    assert "PartitionFilters" in text and "vpuid" in text.split("PartitionFilters")[1]
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["subset_layers_network", "semi_or", "rnr_segment", "reference_in_extent"])
def test_no_pairing_of_all_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text
