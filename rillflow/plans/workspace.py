"""Where intermediate tables are written.

Iterative plans cut their lineage by writing a Parquet table to the folder the cluster shares between executors
(``spark.checkpoint.dir``), so a lost executor costs a re-read and never a replay of the whole iteration. The library
has no folder of its own: where the setting is absent (tests, local runs) the caller names one with ``use_folder``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def use_folder(spark: SparkSession, url: str) -> None:
    """Name the folder for a local session that was started without ``spark.checkpoint.dir``."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster names its shared folder in spark.checkpoint.dir")
    _LOCAL[spark.sparkContext.applicationId] = url.rstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or what ``use_folder`` named."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/rillflow/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a scan of it.

    Scans carry file sizes, so later joins are broadcast only when Spark has checked the size.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing lazy reads them any more."""
    for table in tables:
        spark = table.sparkSession
        folder = shared_dir(spark)
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if "/rillflow/" not in file:
                raise ValueError(f"{file} is not an intermediate table of {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
