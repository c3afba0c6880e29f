"""Raster files as cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions.text import path_part
from rillflow.functions.times import date_in_name, year_in_name


def concat_time(spark: SparkSession, root: str, by: str = "date") -> DataFrame:
    """Cell tables of many dates, the date (or year) of each taken from its file's name.

    Where Spark wrote a file as a folder of parts, the folder's name is the file's; no other part of the path counts.
    """
    cells = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    path = F.col("_metadata.file_path")
    path = path_part(path, F.when(path_part(path, -1).startswith("part-"), -2).otherwise(-1))
    if by == "year":
        return cells.withColumn("year", year_in_name(path))
    return cells.withColumn("date", date_in_name(path))
