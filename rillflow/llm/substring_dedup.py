"""Substring deduplication by relative Lempel-Ziv factors.

The reference that documents are parsed against holds every window of WINDOW words once, where it occurs first: in the
smallest doc_id. It is indexed in blocks. In every window the four-word run with the smallest hash is its anchor, and
windows with equal words have the same anchor at the same place; the anchors (a fifth of all positions) cut a document
into blocks of up to ten windows, filed by the anchor's hash with a short hash of each window. Blocks with an anchor of
one document only are dropped unopened, the others are opened where they lie, and each window finds its place in the
reference, if that is in another document. A document is then parsed greedily: from a window with such a place a factor
goes on as long as the document and the reference do, which is the longest factor there, as no other place of the
reference begins with this window. Windows that lie across a factor's end have entries of their own, so none is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillflow.llm.columns import id_back, id_text
from rillflow.llm.idfilter import may_be_among
from rillflow.llm.tokens import Words, batches, mix, runs, sliding_min
from rillflow.plans.workspace import discard, materialize

WINDOW, ANCHOR = 13, 4
#: Bytes of a window's hash in a block; with the anchor's hash and the place in the block, 104 bits tell windows apart.
SHORT = 5
BLOCK_FIELDS = "anchor long, doc_id long, version long, start int, others binary, ahead int, windows binary"
#: An anchor with this part of all blocks, in one of SAMPLE texts, and LEAST times there, takes the way for frequent ones.
FREQUENT, SAMPLE, LEAST = 1 / 4096, 32, 64


def _blocks(frames: Iterator[pd.DataFrame], frequent: np.ndarray | None = None, only: bool = False) -> Iterator[pd.DataFrame]:
    """(anchor, doc_id, version, start, others, ahead, windows): where the block starts, how far ahead its anchor is, and the hashes.

    Equal blocks of a text are one row, with the other places where they start in ``others``, four bytes each.
    With ``frequent`` those of other anchors, or ``only`` those of these.
    """
    inside = WINDOW - ANCHOR + 1
    for frame in batches(frames):
        words = Words(frame["text"].tolist())
        if len(words) < WINDOW:
            continue
        hashes = words.hashes()
        windows, anchors = runs(hashes, WINDOW), runs(hashes, ANCHOR)
        count = words.counts()
        text = np.repeat(np.arange(len(count)), count)[: len(windows)]
        valid = np.arange(len(windows)) + WINDOW <= words.offsets[text + 1]
        least = sliding_min(anchors, inside)
        # the leftmost anchor of equal ones: positions are compared within the window only
        place = np.full(len(windows), -1, np.int64)
        for step in range(inside - 1, -1, -1):
            at = np.flatnonzero(anchors[step : step + len(windows)] == least)
            place[at] = at + step
        keep = np.flatnonzero(valid)
        if not len(keep):
            continue
        at, text = place[keep], text[keep]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (keep[1:] != keep[:-1] + 1)]))
        short = mix(windows[keep] + np.uint64(1)).view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()
        bound = np.concatenate([first, [len(keep)]])
        start = keep[first]
        # the first and the last window of a block have all its words between them
        same = mix(windows[start] ^ mix(windows[keep[bound[1:] - 1]] + np.uint64(text[first]))) ^ anchors[at[first]]
        _, one, which = np.unique(same, return_index=True, return_inverse=True)
        places = (start - words.offsets[text[first]]).astype(np.int32)
        others: list[bytes | None] = [None] * len(one)
        if len(one) < len(same):
            several = np.flatnonzero(np.bincount(which)[which] > 1)
            several = several[np.argsort(which[several], kind="stable")]
            for group in np.split(several, np.flatnonzero(np.diff(which[several])) + 1):
                others[which[group[0]]] = places[group[1:]].astype(">i4").tobytes()
        found = pd.DataFrame({
            "anchor": anchors[at[first[one]]].view(np.int64),
            "doc_id": frame["doc_id"].to_numpy()[text[first[one]]],
            "version": frame["version"].to_numpy()[text[first[one]]],
            "start": places[one],
            "others": others,
            "ahead": (at[first[one]] - start[one]).astype(np.int32),
            "windows": [short[a * SHORT : b * SHORT] for a, b in zip(bound[:-1][one], bound[1:][one], strict=True)],
        })
        yield found if frequent is None else found[np.isin(found["anchor"].to_numpy(), frequent) == only]


def _least_places(blocks: DataFrame) -> DataFrame:
    """(doc_id, version, copies): the windows of ``blocks`` that begin in a smaller doc_id, wherever, and where first."""
    same = Window.partitionBy("anchor")
    shared = blocks.withColumn("least", F.min("doc_id").over(same)).withColumn("most", F.max("doc_id").over(same)).where("least < most")
    place = F.struct("doc_id", "version", (F.col("start") + F.col("offset")).alias("start"))
    first = F.min(place).over(Window.partitionBy("anchor", "ahead", "window"))
    each = _opened(shared).withColumn("first", first)
    copies = F.transform(_starts(), lambda s: _copy(s + F.col("offset"), F.col("first")))
    return each.where("first.doc_id < doc_id").select("doc_id", "version", copies.alias("copies"))


def _opened(blocks: DataFrame, *more: str) -> DataFrame:
    """A row for each window of the blocks: (anchor, ahead, window) tell its words, (doc_id, version, start + offset) its place."""
    count = (F.length("windows") / SHORT).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("at"), F.substring(F.col("windows"), i * SHORT + 1, F.lit(SHORT)).alias("window")))
    each = blocks.select("anchor", "doc_id", "version", "start", "others", "ahead", *more, F.explode(windows).alias("w"))
    places = ["start", "others", F.col("w.at").alias("offset")]
    return each.select("anchor", "doc_id", "version", *places, *more, (F.col("ahead") - F.col("w.at")).alias("ahead"), "w.window")


def _starts() -> Column:
    """All places where a block starts."""
    count = F.coalesce((F.length("others") / 4).cast("int"), F.lit(0))
    other = lambda i: F.conv(F.hex(F.substring(F.col("others"), 4 * i - 3, F.lit(4))), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.when(i == 0, F.col("start")).otherwise(other(i)))


def _copy(start: Column, first: Column) -> Column:
    return F.struct(start.alias("start"), first["doc_id"].alias("source"), first["start"].alias("place"))


def _least_places_of_frequent(blocks: DataFrame) -> DataFrame:
    """The same for anchors with very many blocks, with partial sums and joins that Spark can split.

    Equal blocks, of which copies have most, are one until the end: their windows are opened once and find their places,
    which then go to all the blocks, a row for each.
    """
    block = ["anchor", "ahead", "windows"]
    first = F.min(F.struct("doc_id", "version", "start")).alias("first")
    different = materialize(blocks.groupBy(*block).agg(first, F.max("doc_id").alias("most")), "different-blocks")
    each = _opened(different.select(*block, "first.*", F.col("most").alias("others"), F.struct(*block).alias("block")), "block")
    window = ["anchor", "ahead", "window"]
    place = F.struct("doc_id", "version", (F.col("start") + F.col("offset")).alias("start"))
    firsts = each.groupBy(*window).agg(F.min(place).alias("first"), F.max("others").alias("most")).where("first.doc_id < most").drop("most")
    found = each.select(*window, "offset", "block").join(materialize(firsts, "first-windows"), window)
    places = found.groupBy("block").agg(F.collect_list(F.struct("offset", "first")).alias("places"))
    places = materialize(places.select("block.*", "places"), "block-places")
    known = blocks.join(places, block).withColumn("places", F.filter("places", lambda p: p["first"]["doc_id"] < F.col("doc_id")))
    copies = F.flatten(F.transform(_starts(), lambda s: F.transform("places", lambda p: _copy(s + p["offset"], p["first"]))))
    return known.select("doc_id", "version", copies.alias("copies"))


def _frequent(texts: DataFrame) -> np.ndarray:
    """The anchors with a FREQUENT part of all blocks or more, in a SAMPLE part of the texts; at most 1 / FREQUENT.

    They only say which of two ways a block takes to the same result.
    """
    part = texts.where(F.pmod(F.xxhash64("doc_id", "version"), F.lit(SAMPLE)) == 0)
    counts = part.mapInPandas(_blocks, BLOCK_FIELDS).groupBy("anchor").count()
    counts = materialize(counts.where("count > 1"), "anchors")
    total = counts.agg(F.sum("count")).first()[0] or 0
    found = counts.where(F.col("count") >= max(FREQUENT * total, LEAST)).select("anchor").collect()
    discard(counts)
    return np.array([r["anchor"] for r in found], np.int64)


def copied_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, copies): the windows of 13 words that also begin in a smaller ``doc_id``, as (start, source, place).

    ``source`` is the smallest such id and ``place`` the window's first word there; ``version`` tells texts with the same
    id apart. A text has a row for each block that holds such windows.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    frequent = _frequent(texts)
    found = _least_places(texts.mapInPandas(lambda frames: _blocks(frames, frequent), BLOCK_FIELDS))
    if not len(frequent):
        return found
    often = materialize(texts.mapInPandas(lambda frames: _blocks(frames, frequent, only=True), BLOCK_FIELDS), "frequent-blocks")
    return found.unionAll(_least_places_of_frequent(often))


def factors(starts: np.ndarray, sources: np.ndarray, places: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, words, source, place) of the greedy parse of a document whose copied windows begin at ``starts`` (ascending).

    A factor goes on while the next window begins one word later here and in the same source. It is as long as the
    reference allows, and the windows across its end begin the next factors, so factors may overlap.
    """
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(sources) != 0) | (np.diff(places) != 1)]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return [(int(starts[a]), int(starts[b] - starts[a]) + WINDOW, int(sources[a]), int(places[a])) for a, b in zip(new, last, strict=True)]


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for frame in frames:
        yield frame[["doc_id", "version"]].assign(packed=[pack.compress((t or "").encode("utf-8", "replace")) for t in frame["text"]])


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result's rows of packed texts and their copies."""
    unpack = zstandard.ZstdDecompressor()
    for whole in frames:
        texts = [unpack.decompress(p).decode() for p in whole["packed"]]
        for frame in batches(iter([whole.drop(columns="packed").assign(text=texts)])):
            yield _results(frame, list(zip(frame["starts"], frame["sources"], frame["places"], strict=True)))


def _untouched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The result's rows of texts without copies."""
    for frame in batches(frames):
        yield _results(frame, [(None, None, None)] * len(frame))


def _results(frame: pd.DataFrame, copies: list[tuple]) -> pd.DataFrame:
    words, rows = Words(frame["text"].tolist()), []
    for i, copied in enumerate(copies):
        gone, found = np.zeros(int(words.offsets[i + 1] - words.offsets[i]), bool), []
        if copied[0] is not None:
            starts, sources, places = (np.asarray(c, np.int64) for c in copied)
            starts, order = np.unique(starts, return_index=True)  # rows that repeat id and text have the same ones
            found = factors(starts, sources[order], places[order])
            for a, k, *_ in found:
                gone[a : a + k] = True
        kept = words.kept(i, ~gone)
        rows.append((len(gone), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode(), found))
    n, removed, digest, kept, found = map(list, zip(*rows, strict=True))
    spans = [[{"start": a, "words": k, "source": s, "place": p} for a, k, s, p in f] for f in found]
    return pd.DataFrame({"doc_id": frame["doc_id"], "n_words": n, "n_removed": removed, "kept_sha256": digest, "kept": kept, "factors": spans})


def remove_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what is left after removing words copied from smaller ids.

    Words are separated by white space and compared unchanged. A word goes if it lies in a window of 13 consecutive
    words whose sequence also starts in a document with a smaller ``doc_id``; windows are judged on the input. Returns
    doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space, in UTF-8), kept (that text) and the
    factors (start, words, source, place), which may overlap: ``source`` is the smallest id that has a factor's windows,
    ``place`` the first word there. A null text has no words. Rows with a null id lose nothing and nothing is copied
    from them; rows that repeat an id are versions of one document, each judged by its own text, and none is a copy of
    another. Other columns are not read. Texts without copies are not moved.
    """
    lists = [F.flatten(F.collect_list(f"copies.{c}")).alias(f"{c}s") for c in ("start", "source", "place")]
    copied = copied_windows(docs).groupBy("doc_id", "version").agg(*lists)
    copied = materialize(copied, "copied-windows")
    among = may_be_among(copied.select(F.col("doc_id").alias("id")))(F.col("doc_id"))
    fields = "doc_id string, n_words long, n_removed long, kept_sha256 string, kept string, factors array<struct<start:int,words:int,source:long,place:int>>"
    rest = docs.select("doc_id", "text").where(~among).select(id_text(), "text").mapInPandas(_untouched, fields)
    packed = docs.select("doc_id", "text").where(among).select(id_text(), F.xxhash64("text").alias("version"), "text")
    packed = id_back(packed.mapInPandas(_packed, "doc_id string, version long, packed binary"))
    joined = packed.join(copied, ["doc_id", "version"], "left").withColumn("doc_id", id_text())
    return id_back(joined.mapInPandas(_parsed, fields).unionAll(rest))
