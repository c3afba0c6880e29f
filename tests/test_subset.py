import pytest
from pyspark.sql import functions as F

from rillflow.catalogue import testdata as td
from rillflow.operators import routing, subset as sub

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def layers(spark):
    return td.layers(spark, SF)


def values(df, column):
    return {r[0] for r in df.select(F.col(f"`{column}`")).collect()}


def test_one_basin_has_core_layers_and_is_consistent(spark, layers):
    found = sub.subset_hydrofabric(layers, td.graph(spark, SF), ["gages-000010"], names=["hydrolocations"], strict=True)
    assert set(found) == {"network", "flowpaths", "nexus", "divides", "hydrolocations"}
    flowpaths = values(found["flowpaths"], "id")
    assert "wb-10" in flowpaths
    assert values(found["flowpaths"], "toid") >= values(found["nexus"], "id")
    assert values(found["divides"], "divide_id") <= values(found["network"], "divide_id")
    assert "order" in found["flowpaths"].columns and "vpus" not in found["flowpaths"].columns


def test_unknown_gauge_raises_when_strict(spark, layers):
    with pytest.raises(ValueError, match="No origin found"):
        sub.subset_hydrofabric(layers, td.graph(spark, SF), ["gages-nope"], strict=True)


def test_unknown_layer_raises(spark, layers):
    ids = spark.createDataFrame([], "basin string, id string, vpus array<string>")
    with pytest.raises(ValueError, match="unknown layers"):
        sub.subset_layers(layers, ids, ["rivers"])


def test_empty_ids_raise_when_required(spark, layers):
    ids = spark.createDataFrame([], "basin string, id string, vpus array<string>")
    with pytest.raises(ValueError, match="No network found"):
        sub.require_rows(sub.subset_layers(layers, ids))


@pytest.mark.parametrize("layer", ["lakes", "divide-attributes", "flowpath-attributes", "flowpath-attributes-ml", "pois", "hydrolocations"])
def test_vpu_subset_takes_optional_layers(layers, layer):
    found = sub.subset_vpu(layers, "08", [layer])
    assert values(found[layer], "vpuid") <= {"08"}
    assert values(found["flowpaths"], "vpuid") == {"08"}


def test_unknown_vpu_raises(layers):
    with pytest.raises(ValueError, match="No network found"):
        sub.subset_vpu(layers, "99", strict=True)


def test_relationship_check_finds_a_lost_divide(layers):
    frames = {name: layers[name] for name in ("network", "flowpaths", "nexus")}
    frames["divides"] = layers["divides"].where("divide_id <> 'cat-5'")
    rows = {r.check: r.violations for r in sub.check_relationships(frames).collect()}
    assert rows["flowpaths.divide_id in divides"] == 1
    assert rows["flowpaths.toid in nexus"] == 0


NETWORK = """id string, toid string, divide_id string, hydroseq double, hf_id double, hf_hydroseq double,
hf_mainstem double, vpuid string"""


def routing_layers(spark, lakes):
    rows = [(f"wb-{i}", f"nex-{i}", f"cat-{i}", float(i), float(i), float(i), 1.0, "01") for i in range(1, 7)]
    network = spark.createDataFrame(rows + [("nex-3", "wb-2", None, None, None, None, None, "01")], NETWORK)
    flowpaths = spark.createDataFrame(
        [(f"wb-{i}", f"nex-{i}", f"cat-{i}", 2.0 if i > 1 else 3.0, str(i), "01") for i in range(1, 7)],
        "id string, toid string, divide_id string, order double, poi_id string, vpuid string",
    )
    empty = spark.createDataFrame([], "poi_id int, id string, divide_id string")
    lake_rows = spark.createDataFrame([(i, float(i), "01") for i in lakes], "poi_id int, hf_id double, vpuid string")
    return {
        "network": network,
        "flowpaths": flowpaths,
        "lakes": lake_rows,
        **{n: empty for n in ("nexus", "divides", "divide-attributes", "pois", "flowpath-attributes", "hydrolocations")},
    }


def test_segment_keeps_the_reach_order_downstream(spark):
    found = routing.rnr_segment(routing_layers(spark, []), [5])
    assert values(found["flowpaths"], "id") == {"wb-2", "wb-3", "wb-4", "wb-5"}
    assert found["lakes"].isEmpty()
    assert values(found["network"], "id") == {"wb-2", "wb-3", "wb-4", "wb-5", "nex-3"}


def test_segment_is_cut_at_the_most_upstream_lake(spark):
    found = routing.rnr_segment(routing_layers(spark, [2, 4]), [5])
    assert values(found["flowpaths"], "id") == {"wb-4", "wb-5"}
    assert values(found["lakes"], "poi_id") == {4}
