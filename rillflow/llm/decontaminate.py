"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

A window has as many words as the benchmark item it may hold (a shorter document is one window). Windows are laid at every
start, but for those that no item can match: of a window as similar as asked, a known part of the shingles are shingles of
items of its size, so the starts follow from the places of these. Each window and item gets a 64-bit SimHash of its
shingles, weighted by how often they occur. Fingerprints are cut into blocks; two within the radius agree in some block
up to ``block_errors`` bits, so the items' blocks are filed under every value that near, and equal joins find for each
window all items within the radius. These pairs are compared exactly.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans.workspace import discard, materialize

BLOCKS, BLOCK_BITS, BLOCK_ERRORS = 8, 8, 2
#: All pairs of fingerprints within this many bits share a block with at most BLOCK_ERRORS wrong bits (pigeonhole). At a
#: similarity of 0.75 the mean distance is 11 bits and the standard deviation 3.
RADIUS = BLOCKS * (BLOCK_ERRORS + 1) - 1
SHINGLE = 5


def _word_hashes(text: Column) -> Column:
    """Hashes of the runs of letters and digits of a text, lower-cased."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(hashes: Column, length: int) -> Column:
    """Hashes of every run of ``length`` words, repeated runs included."""
    starts = F.sequence(F.lit(0), F.size(hashes) - length)
    run = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(length)]))
    return F.when(F.size(hashes) >= length, run).otherwise(F.array().cast("array<bigint>"))


def _shingles_by_length(hashes: Column, length: Column, lengths: list[int]) -> Column:
    """The shingles of a length that is one of ``lengths``."""
    return F.coalesce(*[F.when(length == n, _shingles(hashes, n)) for n in lengths])


def simhash(shingles: Column) -> Column:
    """64 bits, each the majority of that bit among the shingles; bits b and b + 32 are counted together, in halves of a long."""
    low = F.lit((1 << 32) - 1)

    def both(b: Column) -> Column:
        pair = F.lit((1 << 32) + 1)
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda acc, x: acc + F.call_function("shiftrightunsigned", x, b).bitwiseAND(pair))

    def bits(n: Column, b: Column) -> Column:
        one = lambda count, at: F.when(2 * count > F.size(shingles), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
        return one(n.bitwiseAND(low), b).bitwiseOR(one(F.shiftrightunsigned(n, 32), b + 32))

    counts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.struct(both(b).alias("n"), b.alias("b")))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(bits(c["n"], c["b"])))


def _blocks(fingerprint: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1).cast("long")).alias("value")) for b in range(BLOCKS)])


def _common(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags."""

    def each(x: Column) -> Column:
        return F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x)))

    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + each(x))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, item_id, start, similarity): each document that holds an item, the best window, the first of equal ones.

    Words are runs of letters and digits, lower-cased, so case and punctuation hide nothing; a shingle is five words,
    an item of fewer words is one shingle. Similarity is the shared over the joint weight of shingles, the weight being how often one occurs; a window
    counts with ``percent`` or more, wherever it starts. ``start`` is the word the window starts at. Null and empty texts match nothing and
    are matched by nothing; rows with a null id are left out, rows that repeat an id count as versions of one document.
    Other columns are not read. The benchmark is a given set that does not grow with the documents, but is broadcast
    only if Spark finds it small.
    """
    items = benchmark.where("item_id is not null").select("item_id", _word_hashes(F.col("text")).alias("hashes"))
    items = items.withColumn("n", F.size("hashes")).where("n > 0").withColumn("length", F.least("n", F.lit(SHINGLE)))
    items = materialize(items, "items")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # five numbers at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, start int, similarity double")
    bags = items.withColumn("bag", _shingles_by_length(F.col("hashes"), F.col("length"), lengths)).drop("hashes")
    bags = materialize(bags.withColumn("fingerprint", simhash(F.col("bag"))), "item-bags")
    discard(items)
    items = bags

    places = materialize(_places(docs, items, lengths, percent), "places")
    windows = materialize(_windows(docs, places, lengths), "windows")
    discard(places)

    masks = [sum(1 << b for b in bits) for e in range(BLOCK_ERRORS + 1) for bits in combinations(range(BLOCK_BITS), e)]
    filed = items.select("item_id", "n", F.explode(_blocks(F.col("fingerprint"))).alias("b"))
    filed = filed.select("item_id", "n", "b.block", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("b.value").bitwiseXOR(m.cast("long")))).alias("value"))
    probes = windows.select("doc_id", "start", "n", "copy", F.explode(_blocks(F.col("fingerprint"))).alias("b")).select("doc_id", "start", "n", "copy", "b.block", "b.value")
    pairs = probes.join(filed, ["n", "block", "value"]).select("doc_id", "start", "n", "copy", "item_id").distinct()

    right = items.select("item_id", F.col("bag").alias("item_bag"), F.col("fingerprint").alias("item_fingerprint"))
    near = pairs.join(windows, ["doc_id", "start", "n", "copy"]).join(right, "item_id")
    near = near.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint"))) <= RADIUS)
    near = near.withColumn("common", _common(F.col("bag"), F.col("item_bag")))
    near = near.withColumn("joint", F.size("bag") + F.size("item_bag") - F.col("common"))
    near = near.where(100 * F.col("common") >= percent * F.col("joint"))
    best = F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start")))
    near = near.withColumn("similarity", F.col("common") / F.col("joint"))
    return near.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.start", "best.similarity")


def _versions(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, hashes): the words of every row with an id; ``copy`` tells rows with the same id apart."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), _word_hashes(F.col("text")).alias("hashes"))


def _places(docs: DataFrame, items: DataFrame, lengths: list[int], percent: int) -> DataFrame:
    """(doc_id, copy, n, length, starts): the starts of all windows of n words that an item may match.

    Bags of a and b shingles are as similar as asked only if they share percent * (a + b) / (100 + percent) of them. So
    many places in the window begin a shingle of some item of n words, and with the places in order the starts lie
    between the last place of each such number of neighbours and the first.
    """

    def of_length(n: int) -> Column:
        return F.transform(_shingles(F.col("hashes"), n), lambda x, i: F.struct(F.lit(n).alias("length"), i.alias("at"), x.alias("shingle")))

    each = _versions(docs).select("doc_id", "copy", F.size("hashes").alias("words"), F.explode(F.concat(*map(of_length, lengths))).alias("s"))
    parts = items.select("n", "length", F.explode("bag").alias("shingle")).distinct()
    hits = each.select("doc_id", "copy", "words", "s.*").join(parts, ["length", "shingle"])
    hits = hits.groupBy("doc_id", "copy", "words", "n", "length").agg(F.array_sort(F.collect_set("at")).alias("hits"))

    size = F.col("n") - F.col("length") + 1
    own = F.least(size, F.col("words") - F.col("length") + 1)
    hits = hits.withColumn("size", size).withColumn("need", F.ceil(percent * (size + own) / F.lit(100 + percent)).cast("int"))
    hits = hits.where(F.size("hits") >= F.col("need"))

    def between(i: Column) -> Column:
        first = F.greatest(F.get("hits", i + F.col("need") - 1) - F.col("size") + 1, F.lit(0))
        last = F.least(F.get("hits", i), F.col("words") - F.col("n"))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    laid = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits") - F.col("need")), between)))
    starts = F.when(F.col("words") < F.col("n"), F.array(F.lit(0))).otherwise(laid)
    return hits.select("doc_id", "copy", "n", "length", starts.alias("starts")).where(F.size("starts") > 0)


def _windows(docs: DataFrame, places: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, start, n, copy, bag, fingerprint) of the windows at ``places``; rows that repeat id and text have the same ones."""
    texts = _versions(docs.join(places.select("doc_id").distinct(), "doc_id", "left_semi")).join(places, ["doc_id", "copy"])
    rows = texts.select("doc_id", "copy", "n", "length", "hashes", F.explode("starts").alias("start"))
    rows = rows.withColumn("bag", _shingles_by_length(F.slice("hashes", F.col("start") + 1, F.col("n")), F.col("length"), lengths))
    return rows.select("doc_id", "start", "n", "copy", "bag", simhash(F.col("bag")).alias("fingerprint"))
