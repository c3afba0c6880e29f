"""Tables with snapshots: append, replace, tag, look back.

A table is a folder with ``data/batch=N`` Parquet folders and a ``log`` of one row per commit that lists the batches a
snapshot consists of. An append writes its new rows and a log row, never old rows again; reading a snapshot lists only
its batches. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOG = T.StructType(
    [
        T.StructField("snapshot_id", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("batches", T.ArrayType(T.LongType())),
        T.StructField("schema", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("written_at", T.TimestampType()),
    ]
)


def table_log(spark: SparkSession, root: str) -> DataFrame:
    """Commits and tags of a table; empty for a new one."""
    try:
        return spark.read.schema(_LOG).parquet(f"{root}/log")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _LOG)
        raise


def _commits(spark: SparkSession, root: str) -> DataFrame:
    return table_log(spark, root).where(F.col("operation") != "tag")


#: Folder of a snapshot's rows; not allowed as a column.
_BATCH = "rillflow_batch"


def _write_log(spark: SparkSession, root: str, **values) -> None:
    row = tuple(values.get(f.name) for f in _LOG.fields)
    entry = spark.createDataFrame([row], _LOG).withColumn("written_at", F.current_timestamp())
    entry.coalesce(1).write.mode("append").parquet(f"{root}/log")


def _latest(spark: SparkSession, root: str):
    return _commits(spark, root).orderBy(F.desc("snapshot_id")).first()


def _commit(df: DataFrame, root: str, operation: str, message: str, partition_by: list[str]) -> int:
    spark = df.sparkSession
    latest = _latest(spark, root)
    snapshot = latest.snapshot_id + 1 if latest else 1
    if _BATCH in df.columns:
        raise ValueError(f"the column name {_BATCH} is reserved")
    schema, batches = df.schema, [snapshot]
    if operation == "append" and latest:
        known = T.StructType.fromJson(json.loads(latest.schema))
        for field in df.schema.fields:
            if field.name in known.names and field.dataType != known[field.name].dataType:
                held, given = known[field.name].dataType.simpleString(), field.dataType.simpleString()
                raise ValueError(f"column {field.name} is {held}, not {given}")
        added = [f for f in df.schema.fields if f.name not in known.names]
        schema, batches = T.StructType([*known.fields, *added]), [*latest.batches, snapshot]
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{root}/data/{_BATCH}={snapshot}")
    _write_log(
        spark,
        root,
        snapshot_id=snapshot,
        operation=operation,
        batches=batches,
        schema=schema.json(),
        message=message,
    )
    return snapshot


def append_snapshot(df: DataFrame, root: str, message: str = "append", partition_by: list[str] | None = None) -> int:
    """New snapshot: all earlier rows and these; columns are matched by name, new ones added."""
    return _commit(df, root, "append", message, partition_by or [])


def overwrite_snapshot(df: DataFrame, root: str, message: str = "overwrite", partition_by: list[str] | None = None) -> int:
    """New snapshot: these rows only. Older snapshots stay readable."""
    return _commit(df, root, "overwrite", message, partition_by or [])


def append_along_time(df: DataFrame, root: str, column: str = "year", message: str | None = None) -> int:
    """Append further times to an array table, stored by time."""
    return append_snapshot(df, root, message or f"append along {column}", [column])


def as_of(spark: SparkSession, root: str, snapshot_id: int | None = None, tag: str | None = None) -> DataFrame:
    """The table at a snapshot, at a tag, or now."""
    if tag is not None:
        tagged = table_log(spark, root).where((F.col("operation") == "tag") & (F.col("tag") == tag))
        row = tagged.orderBy(F.desc("written_at")).first()
        if row is None:
            raise ValueError(f"no tag {tag!r} in {root}")
        snapshot_id = row.snapshot_id
    if snapshot_id is None:
        commit = _latest(spark, root)
    else:
        commit = _commits(spark, root).where(F.col("snapshot_id") == snapshot_id).first()
    if commit is None:
        raise ValueError(f"no snapshot {snapshot_id} in {root}")
    schema = T.StructType.fromJson(json.loads(commit.schema))
    paths = [f"{root}/data/{_BATCH}={b}" for b in commit.batches]
    return spark.read.option("basePath", f"{root}/data").schema(schema).parquet(*paths).select(
        *[F.col(f"`{n}`") for n in schema.names]
    )


def back_n(spark: SparkSession, root: str, n: int = 1) -> DataFrame:
    """The table n commits ago."""
    row = _commits(spark, root).orderBy(F.desc("snapshot_id")).offset(n).limit(1).first()
    if row is None:
        raise ValueError(f"{root} has no snapshot {n} commits ago")
    return as_of(spark, root, row.snapshot_id)


def history(spark: SparkSession, root: str) -> DataFrame:
    """``(snapshot_id, operation, message, written_at)``, newest first."""
    commits = _commits(spark, root).select("snapshot_id", "operation", "message", "written_at")
    return commits.orderBy(F.desc("snapshot_id"))


def tag_snapshot(spark: SparkSession, root: str, snapshot_id: int, name: str) -> None:
    """Name a snapshot."""
    if _commits(spark, root).where(F.col("snapshot_id") == snapshot_id).isEmpty():
        raise ValueError(f"no snapshot {snapshot_id} in {root}")
    _write_log(spark, root, snapshot_id=snapshot_id, operation="tag", tag=name)


def tags(spark: SparkSession, root: str) -> DataFrame:
    """``(tag, snapshot_id)``."""
    return table_log(spark, root).where(F.col("operation") == "tag").select("tag", "snapshot_id")


def upsert(target: DataFrame, updates: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of the target without a counterpart in the updates, and all updates."""
    keys = [key] if isinstance(key, str) else key
    return target.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def evolve(df: DataFrame, add: Mapping[str, Column] | None = None, drop: list[str] | None = None) -> DataFrame:
    """Add columns (typed nulls or expressions) and drop columns."""
    return df.withColumns(dict(add or {})).drop(*(drop or []))


def domain_history(registry: DataFrame, logs: Mapping[str, DataFrame], domain: str) -> DataFrame:
    """Per layer of a domain: the registered snapshot and its commit, matched by layer name."""
    row = registry.where(F.col("domain") == domain.replace("_hf", ""))
    layers = [c for c in registry.columns if c != "domain"]
    listed = row.unpivot(["domain"], [F.col(f"`{c}`") for c in layers], "layer", "snapshot_id")
    commits = None
    for layer, log in logs.items():
        rows = log.where(F.col("operation") != "tag").select(
            F.lit(layer).alias("layer"), "snapshot_id", "operation", "message"
        )
        commits = rows if commits is None else commits.unionByName(rows)
    return listed.join(commits, ["layer", "snapshot_id"], "left").select(
        "domain", "layer", "snapshot_id", "operation", "message"
    )


def export_namespace(
    spark: SparkSession, source: str, tables: list[str], target: str, domain: str, snapshot: int | None = None
) -> DataFrame:
    """Copy tables of a namespace at a snapshot to a new one; the registry row of the copies.

    The conterminous domain is stored by VPU where a table has one.
    """
    copied = {}
    for table in tables:
        df = as_of(spark, f"{source}/{table}", snapshot)
        by_vpu = ["vpuid"] if domain == "conus_hf" and "vpuid" in df.columns else []
        copied[table] = append_snapshot(df, f"{target}/{table}", f"export of {domain}.{table}", by_vpu)
    ids = [F.lit(v).cast("bigint").alias(t) for t, v in copied.items()]
    return spark.range(1).select(F.lit(domain.replace("_hf", "")).alias("domain"), *ids)
