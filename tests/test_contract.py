import os

import pytest

import __spark_entry__ as contract
from rillflow.plans.workspace import discard, materialize, shared_dir, use_folder


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_flagship_runs(spark):
    df = contract.entry(spark)
    assert df.columns == ["basin", "catchments", "areasqkm", "hydrolocations"]
    assert df.count() == 20


def test_every_section_is_projected(spark):
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    rows = contract.queries()["consolidate_xs_rows"](spark, sf).collect()
    assert len(rows) == items > 4000 and {r.epsg for r in rows} == {5070, 4269, 26914, 2277}
    assert all(r.huc and r.model and r.order_key is not None and r.x is not None and r.y is not None for r in rows)
    places = {(r.epsg, r.x, r.y) for r in rows}
    assert places == {(r.epsg, r.x, r.y) for r in contract.queries()["consolidate_xs"](spark, sf).collect()}


class Session:
    """Stands in for a session without ``spark.checkpoint.dir``."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-" + master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})


def test_shared_folder_is_required():
    for master in ("spark://host:7077", "local[2]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session(master))


def test_only_a_local_session_may_name_its_own_folder():
    use_folder(Session("local[3]"), "file:///scratch/")
    assert shared_dir(Session("local[3]")) == "file:///scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        use_folder(Session("spark://host:7077"), "file:///scratch")


def test_intermediate_tables_are_deleted(spark):
    table = materialize(spark.range(3), "gone")
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    discard(table)
    assert not os.path.exists(path)
