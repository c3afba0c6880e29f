"""Linking sections to the reaches of conflation documents."""

import re

from pyspark.sql import functions as F

from rillflow.catalogue import sections
from rillflow.operators import conflation as cf

XS = "model_id string, huc string, river_reach_rs string, thalweg double, xs_max_elevation double, n int"
SECTION = "struct<river:string,reach:string,xs_id:string,min_elevation:double,max_elevation:double>"
PARSED = f"model_id string, huc string, pos int, reach_id string, network_to_id string, us_xs {SECTION}, ds_xs {SECTION}"


def linked(spark, sections, reaches):
    return cf.composite_key_lookup(spark.createDataFrame(sections, XS), spark.createDataFrame(reaches, PARSED))


def test_lookup_of_covered_bare_and_null_places(spark):
    a, b = ("r", "a", "1", 0.0, 2.0), ("r", "a", "2", float("nan"), 3.0)
    reaches = [
        ("m", "1", 0, "first", "n1", a, b),
        ("m", "1", 1, "last", "n2", a, None),
        ("empty", "1", 0, "no ends", "n3", None, None),
    ]
    rows = [
        ("m", "1", "r a 1", -0.0, 2.0, 1),
        ("m", "1", "r a 2", float("nan"), 3.0, 2),
        ("m", "1", "r a 1", 0.0, 2.5, 3),
        ("m", "1", None, 0.0, 2.0, 4),
        ("empty", "1", "r a 1", 0.0, 2.0, 5),
        ("m", "2", "r a 1", 0.0, 2.0, 6),
        ("bare", "1", "r a 1", 0.0, 2.0, 7),
        (None, "1", "r a 1", 0.0, 2.0, 8),
        ("m", None, "r a 1", 0.0, 2.0, 9),
        ("m", "1", "r a 1", 0.0, 2.0, 10),
    ]
    found = {r.n: tuple(r[c] for c in cf.REACH_IDS) for r in linked(spark, rows, reaches).collect()}
    none = ("None",) * 4
    last, down = ("last", "n2", "None", "None"), ("None", "None", "first", "n1")
    assert found == {1: last, 2: down, 3: none, 4: none, 5: none, 10: last}


def test_sections_are_shuffled_only_by_their_key(spark):
    rows = [("m", "1", "r a 1", 0.0, 2.0, 1), ("bare", "1", "r a 1", 0.0, 2.0, 2)]
    df = linked(spark, rows, [("m", "1", 0, "first", "n1", ("r", "a", "1", 0.0, 2.0), None)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(model_id#\d+, huc#\d+, \d+\)", plan)


def test_sorts_compare_a_number_first(spark):
    """A model's name is longer than what a sort compares at once, so texts alone are read for every comparison."""
    df = linked(spark, [("m", "1", "r a 1", 0.0, 2.0, 1)], [("m", "1", 0, "first", "n1", ("r", "a", "1", 0.0, 2.0), None)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(s.startswith("_mark") for s in re.findall(r"[^a-zA-Z]Sort \[(.*)", plan)) and "_mark" in plan
    documents = sections.conflation(spark, "/root/testdata/sf0.001")
    keys = re.findall(r"ObjectHashAggregate\(keys=\[(\w+)#", documents._jdf.queryExecution().executedPlan().toString())
    assert keys and set(keys) == {"place"}


def test_documents_are_one_for_each_place(spark):
    documents = sections.conflation(spark, "/root/testdata/sf0.001")
    places = sections.conflated_sections(spark, "/root/testdata/sf0.001").select("model", "huc").distinct().count()
    assert documents.columns == ["huc", "kind", "model", "file", "value"]
    assert documents.count() == documents.select("model", "huc").distinct().count() == places
    assert documents.where(F.col("value").isNull()).count() == 0
