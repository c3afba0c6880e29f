"""Mixing sources to target weights by Poisson replication.

A document of a source whose share should be ``w`` of ``N`` documents, and which has ``n`` of them, is repeated
Poisson(w * N / n) times. The count inverts the distribution at a number between 0 and 1 that is hashed from seed and
id, so it is the same on every run, on every cluster, and for any partitioning. Copies are dealt out by a hash of their
own and ordered by it within partitions, which is a global shuffle in one exchange without a sampling pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillflow.llm.columns import unused
from rillflow.plans.workspace import materialize


def unit_hash(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of a text."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def target_rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, rate): the mean number of copies that brings each source to its share.

    ``weights`` has (source, weight) with weights of any sum; sources it lacks get none. Without it the weight of a
    source is its number of documents to the power ``temperature``: 1 keeps the mixture, 0 makes sources equal. A null
    source is a source like others.
    """
    counts = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(float(temperature))))
    else:
        given = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("weight"))
        counts = counts.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(0.0, ["weight"])
    total = counts.agg(F.sum("n").alias("documents"), F.sum("weight").alias("weights"))
    rate = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * F.col("documents") / F.col("n")).otherwise(0.0)
    return counts.join(F.broadcast(total)).select("source", rate.alias("rate"))


def distribution(rates: DataFrame) -> DataFrame:
    """(source, rate, cdf): the cumulative Poisson probabilities of 0, 1, 2, ... until they no longer grow."""
    terms = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    steps = rates.where("rate > 0").select("source", "rate", F.explode(F.sequence(F.lit(0), terms)).alias("k"))
    order = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(F.col("k") > 0, F.ln(F.col("k"))).otherwise(0.0)).over(order)
    steps = steps.withColumn("p", F.exp(F.col("k") * F.ln("rate") - F.col("rate") - logs))
    steps = steps.withColumn("cdf", F.sum("p").over(order))
    lists = steps.groupBy("source", "rate").agg(F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("steps"))
    return lists.select("source", "rate", F.col("steps.cdf").alias("cdf"))


def poisson_mix(docs: DataFrame, rates: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, ``copy`` numbered from 1, and ``shuffle_key``.

    Rows are spread over partitions by ``shuffle_key`` and ordered by it within them. Needs doc_id and source; keeps
    every other column but earlier ``copy`` and ``shuffle_key``. Rows of sources without a rate, or with rate 0, go.
    Rows that repeat an id draw the same number, a null id draws as the text ``null``. No text is looked at, so empty
    and long ones are treated alike; an empty table gives an empty one.
    """
    docs = docs.drop("copy", "shuffle_key")
    of, cdf, draw, n = (unused(c, docs) for c in ("rate_source", "rate_cdf", "rate_draw", "rate_copies"))
    table = materialize(distribution(rates), "poisson").select(F.col("source").alias(of), F.col("cdf").alias(cdf))
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    drawn = docs.withColumn(draw, unit_hash(name)).join(table, F.col("source").eqNullSafe(F.col(of)))
    count = F.size(F.filter(cdf, lambda c: c < F.col(draw)))
    copies = drawn.withColumn(n, count).where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    key = F.md5(F.concat(name, F.lit(":"), F.col("copy").cast("string")))
    copies = copies.withColumn("shuffle_key", key).drop(of, cdf, draw, n)
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
