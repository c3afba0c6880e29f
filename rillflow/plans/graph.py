"""The river graph as an edge table, and upstream traces as ranges of one number.

A flowpath drains to at most one flowpath, so a network is a forest. Its flowpaths are numbered once per network version,
each before all that lies above it and next to it, so "upstream of X" is the range from X's own number to its last one.
The numbers come from pointer jumping, a few joins for each factor of four in depth. Only a network with a cycle, which
has no such numbers, is traced step by step with jump tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.plans.frames import by_shuffle
from rillflow.plans.ranking import running
from rillflow.plans.workspace import discard, materialize

SEA = "wb-0"


def connectivity_edges(flowpaths: DataFrame, network: DataFrame) -> DataFrame:
    """``(src, dst, nexus)``: each flowpath, the flowpath it drains to and the nexus between them.

    A nexus listed with several targets keeps the smallest one, so that every run builds the same graph. Flowpaths
    whose nexus has no target are terminal and have no edge.
    """
    nexus_target = (
        network.where(~F.col("id").startswith("wb-"))
        .groupBy(F.col("id").alias("nexus"))
        .agg(F.min("toid").alias("dst"))
        .where(F.col("dst").isNotNull())
    )
    drains_to = flowpaths.groupBy(F.col("id").alias("src")).agg(F.min("toid").alias("nexus"))
    return drains_to.join(by_shuffle(nexus_target), "nexus").select("src", "dst", "nexus")


def connectivity_nodes(flowpaths: DataFrame) -> DataFrame:
    """Distinct flowpath ids plus the sea node."""
    sea = flowpaths.sparkSession.range(1).select(F.lit(SEA).alias("id"))
    return flowpaths.select("id").unionByName(sea).distinct()


@dataclass(frozen=True)
class RiverGraph:
    """Nodes ``(id)``, edges and, unless the network is ``cyclic``, ``labels (id, first, last)``.

    Upstream of a node, itself included, are the nodes whose ``first`` lies between its own ``first`` and its ``last``.
    """

    nodes: DataFrame
    edges: DataFrame
    labels: DataFrame | None

    @property
    def cyclic(self) -> bool:
        return self.labels is None


def build_graph(flowpaths: DataFrame, network: DataFrame) -> RiverGraph:
    """Write nodes, edges and labels to the shared folder."""
    nodes = materialize(connectivity_nodes(flowpaths), "nodes")
    edges = materialize(connectivity_edges(flowpaths, network), "edges")
    return graph_from_tables(nodes, edges)


def graph_from_tables(nodes: DataFrame, edges: DataFrame) -> RiverGraph:
    """The graph over already written node and edge tables."""
    return RiverGraph(nodes, edges, label_forest(nodes, edges))


def _ancestors(table: DataFrame) -> DataFrame:
    """``table (id, up, ...)`` with ``up2``, ``up3`` and ``up4``: two, three and four times as far down the river."""
    step = by_shuffle(table.select(F.col("id").alias("_from"), F.col("up").alias("_to")))
    for last, name in (("up", "up2"), ("up2", "up3"), ("up3", "up4")):
        table = table.join(step.withColumnsRenamed({"_from": f"_{name}", "_to": name}), F.col(last) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return table


def label_forest(nodes: DataFrame, edges: DataFrame) -> DataFrame | None:
    """``(id, first, last)`` of every node, or None if some nodes drain in a circle.

    First the number of nodes within 4^k steps above each one is summed, until all that lies above is counted: what is 4^k
    steps further up is counted there already. A node's number is then the sum, over the way down from it, of what comes
    before each node of the way among those that drain to the same one, and that is summed by the same jumps. Every round
    writes its table, so no round repeats an earlier one, and the sea, which takes every coastal river, is a group of
    partial sums like others.
    """
    known = nodes.select(F.col("id").alias("dst"))
    down = by_shuffle(edges.join(by_shuffle(known), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("up")))
    table = nodes.select("id").distinct().join(down, "id", "left").withColumn("size", F.lit(1).cast("bigint"))
    table = materialize(table, "sizes")
    rounds, jumps, total = 0, [], 0
    while True:
        nodes_, moving = table.agg(F.count(F.lit(1)), F.count("up")).first()
        total = total or nodes_
        if not moving:
            break
        if 4**rounds > total:  # no way without a cycle is so long
            discard(table, *jumps)
            return None
        far = materialize(_ancestors(table), "jumps")
        jumps.append(far)
        sent = far.select(F.explode(F.array("id", "up", "up2", "up3")).alias("id"), "size").where(F.col("id").isNotNull())
        sizes = sent.groupBy("id").agg(F.sum("size").alias("size"))
        grown = materialize(far.select("id", F.col("up4").alias("up")).join(by_shuffle(sizes), "id"), "sizes")
        discard(table)
        table, rounds = grown, rounds + 1

    sizes = table.select("id", "size")
    siblings = sizes.join(down, "id", "left")
    siblings = running(siblings, ["up"], ["id"], {"through": ("sum", "size")})
    # the first node above another one has the next number; roots begin where the roots before them end
    before = F.col("through") - F.col("size") + F.when(F.col("up").isNull(), 0).otherwise(1)
    first = materialize(siblings.select("id", before.alias("first")), "firsts")
    for far in jumps:
        way = far.select("id", F.explode(F.array("id", "up", "up2", "up3")).alias("at")).where(F.col("at").isNotNull())
        summed = way.join(by_shuffle(first.select(F.col("id").alias("at"), "first")), "at").groupBy("id").agg(F.sum("first").alias("first"))
        summed = materialize(summed, "firsts")
        discard(first, far)
        first = summed
    labels = materialize(first.join(by_shuffle(sizes), "id").select("id", "first", (F.col("first") + F.col("size") - 1).alias("last")), "labels")
    discard(first, table)
    return labels


def trace_upstream(graph: RiverGraph, origins: DataFrame, origin: str = "origin") -> DataFrame:
    """Every ``id`` that drains to each row's ``origin``, the origin itself included; other columns are carried.

    Equal rows of ``origins`` count once and origins outside the graph have no rows. A range of numbers is cut at every
    multiple of BLOCK, so that ranges meet nodes by equality, each pair once.
    """
    origins = origins.distinct()
    if graph.labels is None:
        return _trace_by_jumps(graph, origins, origin)
    keys = origins.columns
    ranges = origins.join(by_shuffle(graph.labels.withColumnRenamed("id", origin)), origin)
    return within(ranges, by_shuffle(graph.labels.select("id", "first")), "first", "first", "last").select(*[F.col(f"`{k}`") for k in keys], "id")


#: Numbers that ranges and points are cut into blocks by.
BLOCK = 1024


def within(
    ranges: DataFrame, points: DataFrame, at: str, first: str, last: str, on: tuple[str, ...] = (), block: float = BLOCK, keep: bool = False
) -> DataFrame:
    """Pairs of a range (columns ``first`` to ``last``) and a point (column ``at``) inside it with equal ``on``.

    Ranges are cut at the multiples of ``block``, so that they meet points by equality. Column ``at`` is left out unless
    it is to be kept; other names have to differ.
    """
    number = lambda c: F.floor(F.col(c) / block)
    cut = ranges.where(F.col(first) <= F.col(last)).withColumn("_block", F.explode(F.sequence(number(first), number(last))))
    placed = points.withColumn("_point", F.col(at)).withColumn("_block", number(at))
    placed = placed if keep else placed.drop(at)
    return cut.join(placed, [*on, "_block"]).where(F.col("_point").between(F.col(first), F.col(last))).drop("_block", "_point")


def _trace_by_jumps(graph: RiverGraph, origins: DataFrame, origin: str) -> DataFrame:
    """The same for a network with cycles: a join for each jump table of 1, 2, 4, ... steps down, and distinct rows."""
    keys = origins.columns
    known = by_shuffle(graph.nodes.select(F.col("id").alias("dst")))
    stay = known.select(F.col("dst").alias("src"), "dst")
    jump = graph.edges.join(known, "dst", "left_semi").select("src", "dst")
    found = origins.withColumn("dst", F.col(origin)).join(known, "dst", "left_semi")
    for level in range(max(1, math.ceil(math.log2(graph.nodes.count() + 1)))):
        found = found.join(by_shuffle(jump.unionByName(stay)), "dst").select(*keys, F.col("src").alias("dst")).distinct()
        onward = by_shuffle(jump.select(F.col("src").alias("dst"), F.col("dst").alias("onward")))
        jump = materialize(jump.join(onward, "dst").select("src", F.col("onward").alias("dst")), f"jump{level + 1}")
    return found.withColumnRenamed("dst", "id")


def upstream_segments(graph: RiverGraph, origins: DataFrame, origin: str = "origin") -> DataFrame:
    """Like :func:`trace_upstream`, but an origin with nothing above it (or an unknown one) yields no rows."""
    has_upstream = by_shuffle(graph.edges.select(F.col("dst").alias(origin)))
    return trace_upstream(graph, origins.join(has_upstream, origin, "left_semi"), origin)


def upstream_adjacency(edges: DataFrame) -> DataFrame:
    """``(id, n_upstream, upstream)``: a row for each flowpath that drains directly to ``id``, and how many there are.

    The sea takes every coastal river, so the tributaries are rows and never a list; the count is a partial aggregate.
    """
    counts = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n_upstream"))
    return edges.join(by_shuffle(counts), "dst").select(F.col("dst").alias("id"), "n_upstream", F.col("src").alias("upstream"))
