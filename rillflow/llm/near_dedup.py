"""Near-duplicate groups: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A text's signature is 70 MinHash values of its distinct five-word shingles, 16 bits of each, cut into 14 blocks of 5. Two
signatures that differ in at most 27 places agree in some block up to one place (pigeonhole), so each block is filed
under its five keys of four values, and equal keys find all such pairs. Farther pairs are found unless every block has
two errors: at a similarity of 0.75 that is 0.367 ** 14, one in a million. Of 64 values four bits each are kept as a
sketch; two texts whose sketches differ in more than MAX_DIFFERENT places are no candidates (at 0.75 the mean is 15 and
the standard deviation 3.4). Beside it lies the parity of the set's hashes in each of PARITY slots: two sets differ in at
least as many shingles as slots, so those that differ in too many slots can't be similar, which rules out most pairs
of 0.5 to 0.7 and loses no link. Candidates are compared on their full sets.

Pairs of a large bucket are not listed. Texts with equal sets are one class with one representative. The members of a
bucket are compared with a few centres of it and what turns out linked is joined into components; only pairs of
different components are left. In a bucket of more than SMALL members such pairs have to meet in a rare shingle as well,
which loses none (prefix filter) and spares a large group the comparison of everyone with everyone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rillflow.llm.columns import id_back, id_text
from rillflow.llm.components import components
from rillflow.llm.idfilter import bitmap, bits_for, chosen, slot_of
from rillflow.llm.tokens import Words, batches, constants, mix, runs
from rillflow.plans.workspace import discard, materialize

SHINGLE = 5
BLOCKS, BLOCK = 14, 5
VALUES = BLOCKS * BLOCK
SKETCH = 64
MAX_DIFFERENT = 35
#: Slots of the parity bitmap of a set. With far more shingles than slots it rules out less.
PARITY = 512
#: Centres of a bucket, and members up to which all pairs between its components are looked at.
CENTRES, SMALL = 4, 64
#: Counters that order shingles by rarity. Shingles share them, which any order common to all texts may.
SLOTS, SLOT_PART = 1 << 16, 1 << 10

_NIBBLES = [f"s{i}" for i in range(SKETCH // 16)]
_PARITIES = [f"p{i}" for i in range(PARITY // 64)]
#: What two texts are judged by before their sets are read: size, sketch and parities.
_MARKS = ["n", *_NIBBLES, *_PARITIES]

_FACTOR, _TERM = constants(VALUES, 11), constants(VALUES, 12)
_ONE, _TWO = constants(2, 13)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of each text; of fewer words the whole sequence is one."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    fives = runs(hashes, SHINGLE)
    out = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(fives[a : b - SHINGLE + 1]))
        else:
            out.append(runs(hashes[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, VALUES) array of 16-bit values; rows of empty sets are 0."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for j in range(VALUES):
            least = np.minimum.reduceat(joined * _FACTOR[j] + _TERM[j], at)
            out[full, j] = (mix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def sketches(values: np.ndarray) -> np.ndarray:
    """(texts, 4) int64: four bits of the first SKETCH values."""
    nibbles = (values[:, :SKETCH] & 15).astype(np.uint64).reshape(len(values), 4, 16)
    return (nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY // 64) int64: for each slot whether an odd number of the set's hashes falls into it."""
    out = np.zeros((len(sets), PARITY // 64), np.int64)
    for at in range(0, len(sets), 1000):
        some = sets[at : at + 1000]
        of = np.repeat(np.arange(len(some)), [len(s) for s in some])
        slots = (np.concatenate(some) % np.uint64(PARITY)).astype(np.int64)
        odd = np.bincount(of * PARITY + slots, minlength=len(some) * PARITY) & 1
        out[at : at + 1000] = np.packbits(odd.astype(np.uint8).reshape(len(some), PARITY), axis=1).view(np.int64)
    return out


def block_keys(values: np.ndarray) -> np.ndarray:
    """(texts, VALUES) int64: for each block and each place in it, a key of the block's other values."""
    blocks = values.reshape(len(values), BLOCKS, BLOCK).astype(np.uint64)
    keys = np.empty((len(values), BLOCKS, BLOCK), np.uint64)
    for place in range(BLOCK):
        packed = np.zeros((len(values), BLOCKS), np.uint64)
        for other in range(BLOCK):
            if other != place:
                packed = (packed << np.uint64(16)) | blocks[:, :, other]
        keys[:, :, place] = packed
    salt = mix(np.arange(VALUES, dtype=np.uint64)).reshape(BLOCKS, BLOCK)
    return mix(keys ^ salt).reshape(len(values), VALUES).view(np.int64)


def _profiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches(frames):
        sets = shingle_sets(frame["text"].tolist())
        values = minhash(sets)
        total = lambda s, c: int(mix(s ^ c).sum(dtype=np.uint64).astype(np.int64))
        yield pd.DataFrame({
            "doc_id": frame["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "one": [total(s, _ONE) for s in sets],
            "two": [total(s, _TWO) for s in sets],
            "signature": [v.tobytes() + p.tobytes() for v, p in zip(values, parities(sets), strict=True)],
        })


def _filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in frames:
        for at in range(0, len(whole), 1000):
            frame = whole.iloc[at : at + 1000]
            stored = np.frombuffer(b"".join(frame["signature"]), np.uint8).reshape(len(frame), -1)
            values = stored[:, : 2 * VALUES].copy().view(np.uint16)
            odd = stored[:, 2 * VALUES :].copy().view(np.int64)
            marks = zip([*_NIBBLES, *_PARITIES], [*sketches(values).T, *odd.T], strict=True)
            yield pd.DataFrame({"id": frame["id"], "keys": list(block_keys(values)), "n": frame["n"], **dict(marks)})


def _different(a: str, b: str) -> Column:
    """In how many places two sketches differ."""
    total = F.lit(0)
    for name in _NIBBLES:
        x = F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether two texts have near sketches and parities that leave similar sets possible.

    Of sizes m and n, enough in common leaves (100 - percent) / (100 + percent) * (m + n) shingles that differ.
    """
    slots = F.lit(0)
    for name in _PARITIES:
        slots = slots + F.bit_count(F.col(f"{a}.{name}").bitwiseXOR(F.col(f"{b}.{name}")))
    sizes = F.col(f"{a}.n") + F.col(f"{b}.n")
    possible = F.greatest(slots, F.abs(F.col(f"{a}.n") - F.col(f"{b}.n"))) * (100 + percent) <= (100 - percent) * sizes
    return (_different(a, b) <= MAX_DIFFERENT) & possible


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows (key, id) whose key has several ids."""
    order = Window.partitionBy("key").orderBy("id")
    rows = rows.withColumn("before", F.lag("id").over(order)).withColumn("after", F.lead("id").over(order))
    return rows.where("before <> id OR after <> id").drop("before", "after")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents with these ids, and of a few more; texts are read where they lie, not moved."""
    bits = bits_for(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids, bits))  # bits / 8 bytes

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(iter([frame[chosen(shared.value, frame["slot"].to_numpy(np.int64))]])):
                sets = shingle_sets(part["text"].tolist())
                yield pd.DataFrame({"id": part["doc_id"], "shingles": [s.view(np.int64) for s in sets]})

    found = docs.select("doc_id", "text", slot_of(F.col("doc_id"), bits).alias("slot")).where("doc_id is not null")
    return found.mapInPandas(work, "id long, shingles array<long>")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(_sets(docs, ids).join(ids, "id", "left_semi"), "sets")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = materialize(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct(), "links")
    discard(sets)
    return links


def _near(rows: DataFrame, centres: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a < b of a bucket's members and its centres that may be links."""
    pairs = rows.alias("r").join(centres.alias("c"), F.col("r.key") == F.col("c.key"))
    pairs = pairs.where((F.col("r.id") != F.col("c.id")) & _may_link("r", "c", percent))
    return pairs.select(F.least("r.id", "c.id").alias("a"), F.greatest("r.id", "c.id").alias("b")).distinct()


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    roots = materialize(components(links), "components")
    rows = rows.drop("root").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return rows.withColumn("root", F.coalesce("root", "id"))


def _links(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links between representatives that connect all that similar pairs connect."""
    fields = ", ".join(["id long", "keys array<long>", *[f"{name} long" for name in _MARKS]])
    signed = reps.where("n_shingles > 0").select("id", F.col("n_shingles").alias("n"), "signature")
    filed = materialize(signed.mapInPandas(_filed, fields), "filed")
    sketch = filed.drop("keys")
    crowded = _crowded(filed.select("id", F.explode("keys").alias("key")).distinct())
    rows = materialize(crowded.join(sketch, "id"), "crowded")

    ranks = [F.min(F.struct(F.xxhash64("id", F.lit(i)), "id", *_MARKS)) for i in range(CENTRES)]
    centres = rows.groupBy("key").agg(F.array_distinct(F.array(*ranks)).alias("c"))
    centres = materialize(centres.select("key", F.explode("c").alias("c")).select("key", "c.id", *[f"c.{name}" for name in _MARKS]), "centres")
    pairs = materialize(_near(rows, centres, percent), "pairs")
    links = _confirmed(docs, pairs, percent)

    rows = _labelled(rows, links)
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("members"))
    sizes = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.sum("members").alias("members")).where("roots > 1")
    mixed = materialize(rows.join(sizes, "key"), "mixed-buckets")
    small = mixed.where(f"members <= {SMALL}")
    few = small.alias("r").join(small.alias("c"), (F.col("r.key") == F.col("c.key")) & _apart(percent))
    few = few.select(F.col("r.id").alias("a"), F.col("c.id").alias("b"))
    large = mixed.where(f"members > {SMALL}").select("id", "root", *_MARKS).distinct()
    rest = few.unionAll(_rare_pairs(docs, materialize(large, "large-buckets"), percent)).distinct()
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "pairs")
    more = _confirmed(docs, rest, percent)
    discard(filed, centres, pairs, mixed, rest)
    return links.unionAll(more)


def _apart(percent: int) -> Column:
    """Members r and c of a bucket that are not connected yet and may be a link, each pair once."""
    return (F.col("r.id") < F.col("c.id")) & (F.col("r.root") != F.col("c.root")) & _may_link("r", "c", percent)


def _slot_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition's counters, in SLOTS / SLOT_PART rows."""
    counts, some = np.zeros(SLOTS, np.int64), False
    for frame in frames:
        for s in frame["shingles"]:
            np.add.at(counts, s % SLOTS, 1)
            some = True
    if some:
        yield pd.DataFrame({"part": np.arange(SLOTS // SLOT_PART), "counts": list(counts.reshape(-1, SLOT_PART))})


def _slot_sums(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": frame["part"].iloc[:1], "counts": [np.sum(np.stack(frame["counts"].to_numpy()), axis=0)]})


def _rare_pairs(docs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of unconnected members that share one of their rarest shingles, as every similar pair does.

    With n shingles, two sets of enough similarity share one of the n - ceil(percent * n / 100) + 1 that come first in
    each, in any order common to all. Rarest first, a text that was edited too much has only its own there and meets
    nobody, however many near copies its bucket holds.
    """
    sets = materialize(_sets(docs, members.select("id")).join(members.select("id"), "id", "left_semi"), "large-sets")
    parts = sets.mapInPandas(_slot_counts, "part int, counts array<long>").groupBy("part").applyInPandas(_slot_sums, "part int, counts array<long>")
    table = np.concatenate([r["counts"] for r in parts.orderBy("part").collect()] or [np.zeros(SLOTS, np.int64)])  # SLOTS numbers
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def rarest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            first = []
            for s in frame["shingles"]:
                order = np.lexsort((s, shared.value[s % SLOTS]))
                first.append(s[order[: len(s) - -(-len(s) * percent // 100) + 1]])
            yield pd.DataFrame({"id": frame["id"], "size": frame["shingles"].str.len(), "first": first})

    prefix = sets.mapInPandas(rarest, "id long, size int, first array<long>").join(members, "id")
    prefix = prefix.select("id", "size", "root", *_MARKS, F.posexplode("first").alias("at", "shingle"))
    prefix = materialize(prefix, "prefixes")
    several = prefix.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
    prefix = materialize(prefix.join(several, "shingle", "left_semi"), "shared-prefixes")
    # from the first shingle that two sets share on, both need as many as they have to share
    enough = F.least(F.col("r.size") - F.col("r.at"), F.col("c.size") - F.col("c.at")) * (100 + percent) >= percent * (F.col("r.size") + F.col("c.size"))
    met = prefix.alias("r").join(prefix.alias("c"), (F.col("r.shingle") == F.col("c.shingle")) & enough & _apart(percent))
    met = materialize(met.select(F.col("r.id").alias("a"), F.col("c.id").alias("b")).distinct(), "met")
    discard(sets, prefix)
    return met


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id and kept.

    Texts are linked when the common shingles are at least ``percent`` of the joint ones; texts without words are linked
    with nothing. ``component_id`` is the smallest doc_id that links reach, ``kept`` whether it is the row's own. A null
    id has a null component and is not kept. Rows that repeat an id are versions of one document, which is linked
    wherever one of them is. Other columns are not read. Equality of sets is judged by their size and 128 bits of hash,
    shingles by 64 bits.
    """
    profiles = docs.select(id_text(), "text").mapInPandas(_profiles, "doc_id string, n_shingles long, one long, two long, signature binary")
    profiles = materialize(id_back(profiles), "profiles")
    same = ["n_shingles", "one", "two"]
    some = profiles.where("doc_id is not null AND n_shingles > 0")
    reps = some.groupBy(*same).agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"))
    reps = materialize(reps, "classes")
    links = _links(docs, reps, percent)
    member = materialize(some.select("doc_id", *same).join(reps.select(*same, "id"), same).select("doc_id", "id").distinct(), "members")
    versions = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("a", "b")
    several = member.groupBy("doc_id").count().where("count > 2").select("doc_id")
    more = member.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    roots = materialize(components(links.unionAll(versions).unionAll(more)), "components")
    named = member.join(roots.withColumnRenamed("node", "id"), "id", "left").select("doc_id", F.coalesce("root", "id").alias("root"))
    smallest = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    owner = named.join(smallest, "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    owner = materialize(owner, "owners")
    out = profiles.select("doc_id", "n_shingles").join(owner, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))
