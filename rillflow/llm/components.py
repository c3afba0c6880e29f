"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.plans.workspace import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that ``links`` (a, b) mention: nodes with the same root are connected.

    Each round points a node at the neighbour (or itself) of least priority, a hash that differs from round to round, and
    contracts the links; a round removes a third of the nodes of a path on average, and more of denser shapes. The
    tables are written, so no round repeats an earlier one. Every step is a grouping with partial sums or a join of
    written tables, whose large keys Spark splits.
    """
    edges = materialize(links.where("a <> b").select("a", "b").distinct(), "links")
    roots, turn = None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("node"))
        sides = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("to"))
        step = materialize(least.select("a", F.col("to.node").alias("to")), "parents")
        if roots is None:
            onward = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            onward = roots.join(step, roots.root == step.a, "left").select("node", F.coalesce("to", "root").alias("root"))
        moved = materialize(onward, "roots")
        left = edges.join(step, "a").select("b", F.col("to").alias("a"))
        both = left.join(step.withColumnsRenamed({"a": "b", "to": "c"}), "b").where("a <> c")
        both = both.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        contracted = materialize(both, "links")
        discard(edges, step, *([roots] if roots is not None else []))
        edges, roots, turn = contracted, moved, turn + 1
    if roots is None:
        return links.sparkSession.createDataFrame([], "node bigint, root bigint")
    discard(edges)
    return roots
