import pytest

from rillflow.operators.origins import find_origin, gages_in_domain, origin_rows, resolve_origins, vpu_filter

SCHEMA = "id string, toid string, vpuid string, hydroseq double, poi_id double, hl_uri string, hf_id double"


def network(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def one(df):
    return df.collect()[0]


def test_smallest_hydroseq_wins(spark):
    nw = network(spark, [("wb-2", "nex-2", "01", 9.0, 1.0, "g", 5.0), ("wb-1", "nex-1", "01", 3.0, 1.0, "g", 6.0)])
    assert one(find_origin(nw, "g")).id == "wb-1"
    assert find_origin(nw, "g", return_all=True).count() == 2


def test_repeated_rows_are_one_origin(spark):
    nw = network(spark, [("wb-1", "nex-1", "01", 3.0, 1.0, "g", 6.0)] * 3)
    assert one(find_origin(nw, "g")).id == "wb-1"


def test_rows_of_one_hydroseq_are_ambiguous(spark):
    nw = network(spark, [("wb-1", "nex-1", "01", 3.0, 1.0, "g", 1.0), ("wb-2", "nex-2", "01", 3.0, 1.0, "g", 2.0)])
    with pytest.raises(ValueError, match="Multiple origins found.*wb-1.*wb-2"):
        find_origin(nw, "g")
    assert one(resolve_origins(origin_rows(nw, "hl_uri"))).ambiguous


def test_null_identifiers_never_match(spark):
    nw = network(
        spark,
        [("wb-NULL001", "nex-1", "01", 1.0, None, None, None), ("wb-VALID001", "nex-2", "01", 2.0, 123.0, "ValidGage", 7.0)],
    )
    assert one(find_origin(nw, "ValidGage")).id == "wb-VALID001"
    assert one(find_origin(nw, 123.0, "poi_id")).id == "wb-VALID001"
    assert origin_rows(nw, "hl_uri").count() == 1


@pytest.mark.parametrize(("value", "kind"), [("nope", "hl_uri"), ("wb-77", "id"), (9.5, "poi_id")])
def test_missing_identifier_raises(spark, value, kind):
    nw = network(spark, [("wb-1", "nex-1", "01", 3.0, 1.0, "g", 1.0)])
    with pytest.raises(ValueError, match="No origin found"):
        find_origin(nw, value, kind)


def test_empty_network_raises(spark):
    with pytest.raises(ValueError, match="No origin found"):
        find_origin(network(spark, []), "g")


def test_vpu_is_not_an_id_type(spark):
    with pytest.raises(ValueError, match="subset_vpu"):
        find_origin(network(spark, []), "01", "vpu_id")


def test_wide_vpu_and_gauges(spark):
    nw = network(spark, [(f"wb-{i}", "n", v, 1.0, 1.0, h, 1.0) for i, (v, h) in enumerate([("08", "gages-1"), ("10U", "gages-1"), ("01", "x-2")])])
    assert vpu_filter(nw, "08").count() == 2
    assert vpu_filter(nw, "01").count() == 1
    assert [r.hl_uri for r in gages_in_domain(nw).collect()] == ["gages-1"]
