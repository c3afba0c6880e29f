"""Late, repeated and corrected observations."""

import os
import time

import pytest
from pyspark.sql import functions as F

from rillflow.streaming.observations import merge_arrivals, observations, stream_observations

SCHEMA = "id string, time timestamp_ntz, value double"


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "id string, time string, value double")
    df.withColumn("time", F.to_timestamp_ntz("time")).coalesce(1).write.mode("append").parquet(folder)


def table(df):
    return sorted(((r.id, str(r.time), r.value) for r in df.collect()), key=str)


def test_late_rows_repeats_and_corrections(spark, shared):
    typed = spark.createDataFrame([], SCHEMA).schema
    source, out, check = (f"{shared}/{n}" for n in ("in", "out", "check"))

    def run():
        stream_observations(spark, source, typed, out, check).awaitTermination()
        return table(observations(spark, out, typed))

    arrive(spark, source, [("g", "2024-01-10", 1.0), ("g", "2024-02-01", 2.0), (None, "2024-01-10", 9.0), ("h", None, 3.0)])
    first = run()
    assert first == sorted([("g", "2024-01-10 00:00:00", 1.0), ("g", "2024-02-01 00:00:00", 2.0), (None, "2024-01-10 00:00:00", 9.0), ("h", "None", 3.0)], key=str)
    before = {r.file for r in spark.read.parquet(f"{out}/month=2024-02").select(F.col("_metadata.file_path").alias("file")).collect()}
    arrive(spark, source, [("g", "2023-12-31", 0.5), ("g", "2024-01-10", 1.0), ("g", "2024-01-11", 4.0)])
    time.sleep(1.1)
    arrive(spark, source, [("g", "2024-01-11", 5.0), (None, "2024-01-10", 8.0)])  # a later file corrects an earlier one
    second = run()
    assert second == sorted([("g", "2023-12-31 00:00:00", 0.5), ("g", "2024-01-10 00:00:00", 1.0), ("g", "2024-01-11 00:00:00", 5.0),
                             ("g", "2024-02-01 00:00:00", 2.0), (None, "2024-01-10 00:00:00", 8.0), ("h", "None", 3.0)], key=str)
    assert {r.file for r in spark.read.parquet(f"{out}/month=2024-02").select(F.col("_metadata.file_path").alias("file")).collect()} == before
    assert table(observations(spark, out, typed, as_of=0)) == first
    assert run() == second


def test_a_repeated_batch_changes_nothing(spark, shared):
    typed = spark.createDataFrame([], SCHEMA).schema

    def batch(rows):
        df = spark.createDataFrame(rows, "id string, time string, value double").withColumn("time", F.to_timestamp_ntz("time"))
        return df.withColumns({"arrived": F.lit("2024-01-01").cast("timestamp"), "arrived_in": F.lit("f")})

    out = f"{shared}/out"
    assert observations(spark, out, typed).count() == 0
    merge_arrivals(batch([("a", "2024-01-01", 1.0), ("b", "2024-01-01", 1.0)]), 0, out)
    merge_arrivals(batch([("a", "2024-01-01", 2.0), ("a", "2024-03-01", 7.0)]), 1, out)
    want = table(observations(spark, out, typed))
    merge_arrivals(batch([("a", "2024-01-01", 2.0), ("a", "2024-03-01", 7.0)]), 1, out)
    assert table(observations(spark, out, typed)) == want == [("a", "2024-01-01 00:00:00", 2.0), ("a", "2024-03-01 00:00:00", 7.0), ("b", "2024-01-01 00:00:00", 1.0)]
    merge_arrivals(batch([]), 2, out)
    assert table(observations(spark, out, typed)) == want
    tie = [("a", "2024-01-01", v) for v in (5.0, 6.0)]
    values = set()
    for k, rows in enumerate((tie, tie[::-1])):
        merge_arrivals(batch(rows), 3 + k, out)
        values.add(table(observations(spark, out, typed))[0][2])
    assert len(values) == 1


def test_names_of_the_table_are_refused(spark, shared):
    typed = spark.createDataFrame([], SCHEMA + ", Version string").schema
    with pytest.raises(ValueError, match="version"):
        stream_observations(spark, shared, typed, f"{shared}/o", f"{shared}/c")
    assert not os.path.exists(f"{shared}/o")
