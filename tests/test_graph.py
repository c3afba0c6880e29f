import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rillflow.operators.subset import semi_or, subset_ids
from rillflow.plans import graph as plans_graph
from rillflow.plans.graph import (
    build_graph,
    connectivity_edges,
    connectivity_nodes,
    graph_from_tables,
    trace_upstream,
    upstream_adjacency,
    upstream_segments,
)
from rillflow.plans.workspace import materialize

PAIR = "id string, toid string"


def tables(spark, flowpaths, nexus):
    network = [(f, t) for f, t in flowpaths] + list(nexus)
    return spark.createDataFrame(flowpaths, PAIR), spark.createDataFrame(network, PAIR)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def chain(first, last, sea=True):
    flowpaths = [(f"wb-{i}", f"nex-{i}") for i in range(first, last + 1)]
    nexus = [(f"nex-{i}", f"wb-{i + 1}") for i in range(first, last)]
    return flowpaths, nexus + ([(f"nex-{last}", "wb-0")] if sea else [])


def test_chain_of_three_has_the_sea_as_fourth_node(spark):
    flowpaths, network = tables(spark, *chain(1, 3))
    assert ids(connectivity_nodes(flowpaths)) == ["wb-0", "wb-1", "wb-2", "wb-3"]
    edges = {(r.src, r.dst): r.nexus for r in connectivity_edges(flowpaths, network).collect()}
    assert edges == {("wb-1", "wb-2"): "nex-1", ("wb-2", "wb-3"): "nex-2", ("wb-3", "wb-0"): "nex-3"}


def test_terminal_flowpath_without_nexus_target_has_no_edge(spark):
    flowpaths = [(f"wb-{i}", f"nex-{i}") for i in range(1, 5)] + [("wb-5", None)]
    nexus = [("nex-1", "wb-2"), ("nex-2", "wb-3"), ("nex-3", "wb-4"), ("nex-4", "wb-0"), ("nex-5", None)]
    fp, nw = tables(spark, flowpaths, nexus)
    assert len(ids(connectivity_nodes(fp))) == 6
    assert ids(connectivity_edges(fp, nw), "src") == ["wb-1", "wb-2", "wb-3", "wb-4"]


@pytest.mark.parametrize(
    ("flowpaths", "nexus", "nodes"),
    [
        ([("wb-1", "nex-1")], [("nex-1", "wb-0")], 2),
        ([], [], 1),
        ([("wb-1", "nex-1"), ("wb-2", "nex-2"), ("wb-3", "nex-3")], [("nex-1", "wb-2"), ("nex-2", "wb-3")], 4),
        (*chain(1001, 1005), 6),
    ],
)
def test_node_counts_of_small_networks(spark, flowpaths, nexus, nodes):
    fp, nw = tables(spark, flowpaths, nexus)
    graph = build_graph(fp, nw)
    assert graph.nodes.count() == nodes
    assert not graph.cyclic


def test_duplicate_nexus_rows_keep_the_smallest_target(spark):
    fp, nw = tables(spark, [("wb-1", "nex-1")], [("nex-1", "wb-9"), ("nex-1", "wb-2")])
    assert ids(connectivity_edges(fp, nw), "dst") == ["wb-2"]


def test_headwater_and_unknown_origin_have_no_upstream(spark):
    graph = build_graph(*tables(spark, *chain(1, 3)))
    origins = spark.createDataFrame([("wb-1",), ("wb-none",), ("wb-3",)], "origin string")
    found = [(r.origin, r.id) for r in upstream_segments(graph, origins).collect()]
    assert sorted(found) == [("wb-3", "wb-1"), ("wb-3", "wb-2"), ("wb-3", "wb-3")]


def test_subset_ids_add_the_nexus_except_for_headwaters(spark):
    graph = build_graph(*tables(spark, *chain(1, 3)))
    origins = spark.createDataFrame([("b1", "wb-1", "nex-1"), ("b3", "wb-2", "nex-2")], "basin string, id string, toid string")
    found = sorted((r.basin, r.id) for r in subset_ids(graph, origins).collect())
    assert found == [("b1", "wb-1"), ("b3", "nex-2"), ("b3", "wb-1"), ("b3", "wb-2")]


def brute_force(down, origin):
    above = defaultdict(set)
    for a, b in down.items():
        above[b].add(a)
    seen, todo = set(), [origin]
    while todo:
        node = todo.pop()
        if node not in seen:
            seen.add(node)
            todo += above[node]
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_trace_equals_search_on_random_graphs_with_and_without_cycles(spark, seed):
    rng = random.Random(seed)
    n = 40
    down = {}
    for i in range(1, n):
        target = rng.randrange(n) if seed == 2 else rng.randrange(i)
        if target != i:
            down[f"n{i}"] = f"n{target}"
    nodes = materialize(spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string"), "nodes")
    edges = materialize(spark.createDataFrame([(a, b, "x") for a, b in down.items()], "src string, dst string, nexus string"), "edges")
    graph = graph_from_tables(nodes, edges)
    origins = nodes.select(F.col("id").alias("origin"))
    rows = [(r.origin, r.id) for r in trace_upstream(graph, origins).collect()]
    assert len(rows) == len(set(rows))
    expected = {(o, x) for o in (f"n{i}" for i in range(n)) for x in brute_force(down, o)}
    assert set(rows) == expected


def random_forest(rng, n, wide):
    """Parents by number: mostly one deep stem, or many rivers into few nodes."""
    down = {i: (rng.randrange(max(0, i - 3), i) if not wide else rng.randrange(min(i, 4))) for i in range(1, n)}
    return {i: t for i, t in down.items() if rng.random() > 0.03}


@pytest.mark.parametrize("wide", [False, True])
def test_labels_are_nested_ranges(spark, wide):
    n, down = 400, random_forest(random.Random(7), 400, wide)
    nodes = materialize(spark.createDataFrame([(f"n{i}",) for i in range(n)], "id string"), "nodes")
    edges = [(f"n{a}", f"n{b}", "x") for a, b in down.items()] + [("n0", "unknown", "x")]
    graph = graph_from_tables(nodes, materialize(spark.createDataFrame(edges, "src string, dst string, nexus string"), "edges"))
    labels = {int(r.id[1:]): (r.first, r.last) for r in graph.labels.collect()}
    assert sorted(f for f, _ in labels.values()) == list(range(n))
    number = {f: i for i, (f, _) in labels.items()}
    for i, (first, last) in labels.items():
        assert {number[k] for k in range(first, last + 1)} == brute_force(down, i)


def test_deep_chain_needs_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr("rillflow.plans.graph.materialize", lambda df, name: written.append(name) or materialize(df, name))
    graph = build_graph(*tables(spark, *chain(1, 300)))
    assert written.count("jumps") == 5  # 4 ** 5 > 300
    origin = spark.createDataFrame([("wb-0",)], "origin string")
    assert upstream_segments(graph, origin).count() == 301


def test_ranges_meet_points_once_each(spark):
    from rillflow.plans.graph import BLOCK, within

    points = spark.createDataFrame([(i * 97, "g" if i % 2 else "h") for i in range(200)], "at long, g string")
    edge = [(0, BLOCK - 1), (BLOCK, BLOCK), (5, 9 * BLOCK + 3), (3, 2), (BLOCK * 2 - 1, BLOCK * 2)]
    ranges = spark.createDataFrame([(a, b, "g") for a, b in edge], "lo long, hi long, g string")
    got = sorted((r.lo, r.hi, r["at"]) for r in within(ranges, points, "at", "lo", "hi", ("g",), keep=True).collect())
    assert got == sorted((a, b, i * 97) for a, b in edge for i in range(1, 200, 2) if a <= i * 97 <= b)


def test_adjacency_has_a_row_for_each_tributary(spark):
    edges = spark.createDataFrame([(f"wb-{i:03d}", "wb-0", "x") for i in range(1, 101)] + [("wb-200", "wb-001", "x")], "src string, dst string, nexus string")
    rows = sorted(tuple(r) for r in upstream_adjacency(edges).collect())
    assert rows == [("wb-0", 100, f"wb-{i:03d}") for i in range(1, 101)] + [("wb-001", 1, "wb-200")]


def test_semi_or_keeps_repeated_rows_once_each(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("c", "d")], PAIR)
    ids_frame = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    assert semi_or(df, "id", "toid", ids_frame).count() == 3


def test_what_grows_with_the_network_is_not_sent_through_the_driver(spark, monkeypatch):
    plans = []

    def kept(df, name, path=None):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name, path)

    monkeypatch.setattr(plans_graph, "materialize", kept)
    built = build_graph(*tables(spark, *chain(1, 40)))
    origins = built.nodes.select(F.col("id").alias("origin"))
    plans += [("trace", upstream_segments(built, origins)._jdf.queryExecution().executedPlan().toString())]
    basins = built.nodes.select(F.col("id").alias("basin"), "id", F.lit("nex-1").alias("toid"))
    plans += [("subset", subset_ids(built, basins)._jdf.queryExecution().executedPlan().toString())]
    assert {"jumps", "labels", "trace", "subset"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
