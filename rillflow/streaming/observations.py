"""Gauge files as they arrive: the continuous form of appending observations along time, with corrections.

The table is stored by month, and a month in versions. A batch of arrivals makes a new version of the months that it
touches, and of no others: what the month held and what arrived, the last arrival of a gauge and time. A version is
numbered by its batch, so a batch that is repeated after a failure writes the same version again, from the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructType

_ARRIVED, _FILE, _MONTH, _VERSION = "arrived", "arrived_in", "month", "version"


def observation_stream(spark: SparkSession, source: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Files in a folder as a stream of ``(id, time, ...)`` rows, with the time and the name of the file."""
    rows = spark.readStream.schema(schema).format(fmt).load(source)
    return rows.select("*", F.col("_metadata.file_modification_time").alias(_ARRIVED), F.col("_metadata.file_path").alias(_FILE))


def _month() -> Column:
    return F.coalesce(F.date_format("time", "yyyy-MM"), F.lit("none"))


def _last(rows: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """Of the rows of a gauge and time the last by ``order``, and of equal ones the same on every run."""
    rest = [F.col(f"`{c}`") for c in columns if c not in ("id", "time")]
    last = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest))).alias("_last")
    return rows.groupBy("id", "time").agg(last).select("id", "time", "_last.*")


def _exists(spark: SparkSession, out: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _versions(spark: SparkSession, out: str, schema: StructType, before: int | None = None, months: list[str] | None = None) -> DataFrame:
    """The rows of the last version (before a batch) of each month (of some). Other versions' files are not read."""
    stored = StructType([*schema.fields]).add(_MONTH, StringType()).add(_VERSION, LongType())
    table = spark.read.schema(stored).parquet(out)
    if before is not None:
        table = table.where(F.col(_VERSION) < before)
    if months is not None:
        table = table.where(F.col(_MONTH).isin(months))
    newest = table.groupBy(_MONTH).agg(F.max(_VERSION).alias(_VERSION))  # of folder names only
    chosen = [(r[_MONTH], r[_VERSION]) for r in newest.collect()]  # a row for each month
    pick = F.lit(False)
    for month, version in chosen:
        pick = pick | ((F.col(_MONTH) == month) & (F.col(_VERSION) == version))
    return table.where(pick).drop(_MONTH, _VERSION)


def merge_arrivals(batch: DataFrame, number: int, out: str) -> None:
    """Make version ``number`` of every month that the batch has rows of, however late they come.

    A later file counts more than an earlier one, within a batch too, and a batch more than what was there.
    """
    spark = batch.sparkSession
    columns = [c for c in batch.columns if c not in (_ARRIVED, _FILE)]
    schema = batch.select(*[F.col(f"`{c}`") for c in columns]).schema
    new = _last(batch, columns, _ARRIVED, _FILE).withColumn("_turn", F.lit(1))
    months = [r[0] for r in batch.select(_month()).distinct().collect()]  # a few for each arrival
    if not months:
        return
    if _exists(spark, out):
        held = _versions(spark, out, schema, number, months).withColumn("_turn", F.lit(0))
        new = new.unionByName(held)
    merged = _last(new, columns, "_turn").select(*[F.col(f"`{c}`") for c in columns])
    merged = merged.withColumns({_MONTH: _month(), _VERSION: F.lit(number).cast("bigint")})
    writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(_MONTH, _VERSION).parquet(out)


def observations(spark: SparkSession, out: str, schema: StructType, as_of: int | None = None) -> DataFrame:
    """The observations as they are known now, or after batch ``as_of``; each gauge and time once."""
    if not _exists(spark, out):
        return spark.createDataFrame([], schema)
    return _versions(spark, out, schema, None if as_of is None else as_of + 1)


def stream_observations(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, continuous: bool = False
) -> StreamingQuery:
    """Merge arriving files into the table of :func:`observations`; until all files are read, or for good."""
    taken = {_ARRIVED, _FILE, _MONTH, _VERSION, "_turn", "_last"} & {n.lower() for n in schema.names}
    if taken:
        raise ValueError(f"the table keeps columns of its own by these names: {', '.join(sorted(taken))}")
    rows = observation_stream(spark, source, schema)
    writer = rows.writeStream.foreachBatch(lambda batch, number: merge_arrivals(batch, number, out))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime="1 minute") if continuous else writer.trigger(availableNow=True)
    return writer.start()
