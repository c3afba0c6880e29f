"""Sharding by jump consistent hashing: stable keys go to shards without a table of the ring.

A key seeds a linear congruential generator, and the generator says at which shard counts the key jumps to the newest
shard. So key and shard count alone decide, keys spread evenly, and one more shard takes 1 / (n + 1) of the keys, into
itself only. The walk is a fold over at most ``shards`` steps in Column arithmetic, on halves of the 64-bit state, as
products of whole states would not fit in a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.plans.ranking import with_rank
from rillflow.plans.workspace import materialize

SHARDS = 24
#: Fixed value: the multiplier of the generator that jump consistent hashing is published with.
MULTIPLIER = 2862933555777941757
#: A row counts as its text and as much as its id takes.
ID_BYTES = 8

_LOW16, _LOW32 = (1 << 16) - 1, (1 << 32) - 1


def key_halves(key: Column) -> tuple[Column, Column]:
    """The first 64 bits of the MD5 of a key, as two unsigned 32-bit numbers. A null key is the empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _times(value: Column, factor: int) -> tuple[Column, Column]:
    """value * factor for 32-bit numbers, as the low 32 bits and the rest; no step exceeds 50 bits."""
    low, high = value * F.lit(factor & _LOW16), value * F.lit(factor >> 16)
    sum_ = low.bitwiseAND(F.lit(_LOW32)) + F.shiftleft(high.bitwiseAND(F.lit(_LOW16)), 16)
    return sum_.bitwiseAND(F.lit(_LOW32)), F.shiftright(low, 32) + F.shiftright(high, 16) + F.shiftright(sum_, 32)


def next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2 ** 64, for the state high * 2 ** 32 + low."""
    product, carry = _times(low, MULTIPLIER & _LOW32)
    product = product + 1
    upper = carry + F.shiftright(product, 32) + _times(high, MULTIPLIER & _LOW32)[0] + _times(low, MULTIPLIER >> 32)[0]
    return upper.bitwiseAND(F.lit(_LOW32)), product.bitwiseAND(F.lit(_LOW32))


def _leap(at: Column, high: Column) -> Column:
    """The shard count beyond which a key at shard ``at`` moves on, by the upper 31 bits of its state."""
    return F.floor((at + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1)))


def jump_shard(halves: tuple[Column, Column], shards: int) -> Column:
    """(shard, grown): where a key belongs among ``shards`` shards, and among one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def state(high: Column, low: Column, at: Column) -> Column:
        return F.struct(high.alias("high"), low.alias("low"), at.cast("long").alias("at"))

    def step(now: Column, _: Column) -> Column:
        onward = _leap(now["at"], now["high"])
        return F.when(onward < shards, state(*next_state(now["high"], now["low"]), onward)).otherwise(now)

    def found(last: Column) -> Column:
        grown = F.when(_leap(last["at"], last["high"]) == shards, F.lit(shards)).otherwise(last["at"])
        return F.struct(last["at"].cast("int").alias("shard"), grown.cast("int").alias("grown"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state(*next_state(*halves), F.lit(0)), step, found)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 8, ``text_crc32`` the unsigned checksum of the same bytes; a null text has
    none, as an empty one. ``law`` is ``key``: doc_id and the number of shards decide, so rows that repeat an id share a
    shard, as do all null ids, which count as the empty key; equal texts of different ids do not. ``slot`` numbers the
    rows of a shard from 0 without gaps, in the order of the hashed key, then id, checksum and size; rows equal in all
    of them take neighbouring slots. ``grown_shard`` is the shard when there is one more. Only doc_id and text are read,
    so other columns may have any name, and an empty table gives an empty one. Texts are read once and never moved;
    the numbering range-partitions narrow rows, each with a number of its own, so no shard and no key is one task's.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    high, low = key_halves(F.col("doc_id"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + ID_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        high.alias("high"),
        low.alias("low"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("jump", jump_shard((F.col("high"), F.col("low")), shards))
    rows = rows.select("doc_id", "size", "text_crc32", "high", "low", "row", F.col("jump.shard").alias("shard"), F.col("jump.grown").alias("grown_shard"))
    order = ["high", "low", "doc_id", "text_crc32", "size", "row"]
    placed = with_rank(materialize(rows, "shard-rows"), ["shard"], order)
    slot = (F.col("rank") - 1).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, mode: str = "errorifexists") -> str:
    """Write all rows and columns of ``docs`` to one folder for each shard; returns the name of the folders' column.

    It is ``shard``, with underscores before it while ``docs`` has such a column. Rows are range-partitioned by shard and
    hashed key, so a shard is as many files as it needs, and each file follows the order of the slots.
    """
    column, at = "shard", "shard_key"
    taken = {c.lower() for c in docs.columns}
    while column in taken:
        column = f"_{column}"
    while at in taken:
        at = f"_{at}"
    key = docs.withColumn(at, F.struct(*(h.alias(n) for h, n in zip(key_halves(F.col("doc_id")), ("high", "low"), strict=True))))
    sharded = key.withColumn(column, jump_shard((F.col(f"{at}.high"), F.col(f"{at}.low")), shards)["shard"])
    order = [column, f"{at}.high", f"{at}.low", F.xxhash64("text")]
    ordered = sharded.repartitionByRange(*order).sortWithinPartitions(*order).drop(at)
    ordered.write.mode(mode).partitionBy(column).parquet(path)
    return column
