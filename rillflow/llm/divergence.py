"""Source divergence audit: how the sources of a language differ in their words.

CountVectorizer fits the vocabulary, with minDF and the largest vocabSize. What a language keeps, the terms in at least
minDF of its documents, has so many documents of all languages too, so one model holds the vocabulary of each language,
however many there are. By it every document becomes an exact sparse vector; documents are counted from the vectors for
each language, and entries are summed by group, as Summarizer sums vectors but without their zeros. Sources are compared
term by term where both have one; what a pair of sources has without a common term follows from sums of each side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.plans.workspace import materialize

MIN_DOCUMENTS = 30
#: A term seen nowhere counts as this many.
SMOOTHING = 5
#: Shares are whole parts of this.
SCALE = 1_000_000_000
TERM_RANKS = 50
#: The largest vocabulary there can be: no term that is frequent enough is left out.
MAX_TERMS = 2**31 - 1
#: Texts that are split together, entries that a task sums at once, and that it passes on together.
ROWS, HELD, PIECE = 1024, 1 << 20, 1 << 16
#: What bytes of UTF-8 become before a text is split at spaces: A-Z their small letters, all else in ASCII but a-z a space.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def _split(texts: pa.Array) -> pa.Array:
    """The terms of each text; the whole column is looked up and split at once."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    plain = pa.py_buffer(b"" if data is None else _BYTES[np.frombuffer(data, np.uint8)])
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, plain], 0, texts.offset))


def document_terms(docs: DataFrame) -> DataFrame:
    """(terms): the terms of each document, and empty ones where a text starts or ends with a break."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays([_split(batch.column(0).slice(at, ROWS))], ["terms"])

    return docs.select("text").mapInArrow(split, "terms array<string>")


def fit_vocabulary(docs: DataFrame, min_documents: int) -> list[str]:
    """The terms of at least ``min_documents`` documents, the model's; a term's place is its index in vectors.

    They lie on the driver, as CountVectorizer has them, a set that grows much more slowly than the documents. The empty
    term is added to as many rows, so that there always is one; no vector has it.
    """
    filler = docs.sparkSession.range(min_documents).select(F.array(F.lit("")).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_documents), vocabSize=MAX_TERMS)
    return counter.fit(document_terms(docs).unionAll(filler)).vocabulary


Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]


def _vectors(texts: pa.Array, vocabulary: pa.Array) -> Vectors:
    """(row, index, count) of the entries of the texts' vectors, by row and index."""
    terms = _split(texts)
    index = pc.index_in(terms.flatten(), vocabulary)
    row = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    known = index.is_valid().to_numpy(zero_copy_only=False)
    keys, counts = np.unique(row[known] * len(vocabulary) + index.drop_null().to_numpy(), return_counts=True)
    rows, indices = np.divmod(keys, max(len(vocabulary), 1))
    return rows, indices, counts


def _with_vocabulary(docs: DataFrame, vocabulary: list[str]) -> tuple[DataFrame, Broadcast]:
    """(lang, source, text) and the vocabulary for the tasks, as CountVectorizer's model sends it."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    words = pa.array([None if w == "" else w for w in vocabulary], pa.string())
    return docs.select(of("lang"), of("source"), "text"), docs.sparkSession.sparkContext.broadcast(words)


def document_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(lang, source, indices, counts) of every document: its sparse vector over the vocabulary."""
    rows, words = _with_vocabulary(docs, vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, index, count = _vectors(part.column(2), words.value)
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (index.astype(np.int32), count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["lang", "source", "indices", "counts"])

    return rows.mapInArrow(each, "lang string, source string, indices array<int>, counts array<long>")


def group_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(lang, source, index, count, documents): the vectors' entries summed by group, and how many vectors have one.

    Tasks sum the vectors that they make, in arrays of bounded size, before anything is shuffled.
    """
    rows, words = _with_vocabulary(docs, vocabulary)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[Vectors] = []
        waiting = 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                names = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                group = np.array([groups.setdefault(g, len(groups)) for g in names], np.int64)
                row, index, count = _vectors(part.column(2), words.value)
                held.append(((group[row] << 32) | index, count.astype(np.int64), np.ones(len(row), np.int64)))
                waiting += len(row)
                if waiting >= HELD:
                    held[:] = [_reduced(held)]
                    waiting = len(held[0][0])
                    if 2 * waiting >= HELD:
                        yield from _written(held.pop(), groups)
                        waiting = 0
        if held:
            yield from _written(_reduced(held), groups)

    partial = rows.mapInArrow(summed, "lang string, source string, index int, count long, documents long")
    return partial.groupBy("lang", "source", "index").agg(*[F.sum(c).alias(c) for c in ("count", "documents")])


def _reduced(held: list[Vectors]) -> Vectors:
    keys, counts, documents = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first), np.add.reduceat(documents[order], first)


def _written(sums: Vectors, groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
    for a in range(0, len(sums[0]), PIECE):
        keys, counts, documents = (x[a : a + PIECE] for x in sums)
        columns = [n.take(pa.array(keys >> 32)) for n in names]
        columns += [pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts), pa.array(documents)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "index", "count", "documents"])


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), in whole numbers of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = (wide(count) + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)")
    below = wide(total) + wide(terms) * SMOOTHING
    return F.call_function("div", above, below) + 1


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs in ``docs``.

    Null text, lang and source count as empty. A language keeps the terms that ``min_documents`` of its documents hold.
    Part ``pair`` has each other source of the language and the distance of their smoothed shares, summed over all kept
    terms (0 without any); part ``term`` the kept terms that the source uses more than its language does, by the
    difference, down to rank ``term_ranks``. Ranks go by falling value, then by the item's UTF-8. Repeated rows count as
    often as they occur; other columns are not read; an empty table gives an empty one.
    """
    vocabulary = fit_vocabulary(docs, min_documents)
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = materialize(docs.select(of("lang"), of("source")).distinct(), "groups")
    counts = materialize(group_counts(docs, vocabulary), "group-counts")
    words = docs.sparkSession.createDataFrame(pa.table({"index": pa.array(range(len(vocabulary)), pa.int32()), "term": pa.array(vocabulary, pa.string())}))
    held = counts.groupBy("lang", "index").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= min_documents)
    vocabulary = materialize(held.join(words, "index").select("lang", "index", "term"), "vocabularies")
    counts = materialize(counts.join(vocabulary.select("lang", "index"), ["lang", "index"], "left_semi").drop("documents"), "kept-counts")

    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = groups.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["terms", "total"])
    none = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1))))
    groups = materialize(groups.withColumn("none", F.coalesce(none, F.lit(0).cast("long"))), "groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("total"), F.col("terms")))
    shares = materialize(shares.select("lang", "source", "index", "p", "none"), "shares")
    pairs = _pairs(groups, shares).withColumn("part", F.lit("pair"))
    tops = _terms(counts, groups, shares, vocabulary).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value"]
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select(*columns).withColumn("rank", F.row_number().over(order))
    tops = tops.select(*columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= term_ranks)
    return pairs.unionByName(tops)


def _terms(counts: DataFrame, groups: DataFrame, shares: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms a source uses more than its language."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    of_lang = counts.groupBy("lang", "index").agg(F.sum("count").alias("count")).join(whole, "lang")
    of_lang = of_lang.select("lang", "index", _share(F.col("count"), F.col("total"), F.col("terms")).alias("q"))
    above = shares.join(of_lang, ["lang", "index"]).where("p > q").select("lang", "source", "index", (F.col("p") - F.col("q")).alias("value"))
    return above.join(vocabulary, ["lang", "index"]).select("lang", "source", F.col("term").alias("item"), "value")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways round.

    With s and t for the shares of a term that a source lacks, a term that only one side has differs by |p - t|, one that
    neither has by |s - t|. So the sum starts as terms * |s - t|, each side's own terms add |p - t| - |s - t|, and only
    terms of both sides need both shares. The smaller name comes first; every sum is one of partial sums.
    """
    a = groups.select("lang", F.col("source").alias("a"), F.col("none").alias("s"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("t"))
    both = a.join(b, "lang").where("a <> b")
    base = both.where("a < b").select("lang", "a", "b", (F.col("terms") * F.abs(F.col("s") - F.col("t"))).alias("value"))
    own = shares.select("lang", F.col("source").alias("a"), "p").groupBy("lang", "a", "p").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(both, ["lang", "a"])
    own = own.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n") * (F.abs(F.col("p") - F.col("t")) - F.abs(F.col("s") - F.col("t")))).alias("value"))
    left = shares.select("lang", "index", F.col("source").alias("a"), F.col("p").alias("p"), F.col("none").alias("s"))
    right = shares.select("lang", "index", F.col("source").alias("b"), F.col("p").alias("r"), F.col("none").alias("t"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    common = left.join(right, ["lang", "index"]).where("a < b")
    common = common.select("lang", "a", "b", (gap("p", "r") - gap("p", "t") - gap("s", "r") + gap("s", "t")).alias("value"))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (own, common)]
    sums = base.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", F.explode(sides).alias("side"), "value").select("lang", "side.*", "value")
