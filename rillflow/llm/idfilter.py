"""Which rows may have one of some ids, told where the rows lie: a bitmap of the ids' hashes, the same size for any number."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fewest and the most bits of a bitmap, 2 and 128 MB. Beyond some 10 ** 8 ids ever more rows pass that have none of
#: them, never fewer.
BITS, MOST_BITS = 1 << 24, 1 << 30


def bits_for(ids: DataFrame) -> int:
    """Ten bits for each id, as a power of two, within bounds."""
    return min(MOST_BITS, max(BITS, 1 << (10 * ids.count()).bit_length()))


def slot_of(id_: Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(id_.cast("long")), F.lit(bits))


def bitmap(ids: DataFrame, bits: int = BITS) -> np.ndarray:
    """``bits`` bits, set at the slots of the column ``id``; made in pieces by the executors."""
    slot = slot_of(F.col("id"), bits) + 1  # pieces count from 1, as do the bits of all of them
    pieces = ids.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():
        out[(r["piece"] - 1) * 4096 : r["piece"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def chosen(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def may_be_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of an id column: true for every one of ``ids``, and for a few others; never null."""
    bits = bits_for(ids)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap(ids, bits))  # bits / 8 bytes

    @F.pandas_udf("boolean")
    def hit(slot: pd.Series) -> pd.Series:
        return pd.Series(chosen(shared.value, slot.to_numpy(np.int64)))

    return lambda id_: hit(slot_of(id_, bits))
