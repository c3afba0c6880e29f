"""Labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Parts that labelled ids are dealt out to by their hash; a sample is as many of them as fit.
BUCKETS = 4096


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, train: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled rows that ``train`` admits, in whole parts of the hashed ids.

    The bound makes the sample small enough to be sent to the texts; these stay where they are. Null labels and ids are
    left out; of contradicting labels of one id the larger counts.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(train)
    chosen = chosen.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = chosen.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    sizes, total, last = chosen.groupBy("at").count().orderBy("at").collect(), 0, -1  # BUCKETS numbers
    for size in sizes:
        total += size["count"]
        if total > rows:
            break
        last = size["at"]
    chosen = chosen.where(F.col("at") <= last).drop("at")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
