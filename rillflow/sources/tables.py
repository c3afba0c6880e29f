"""Layer and table readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.text import quoted
from rillflow.operators import versions
from rillflow.schemas import contract, required


def read_layer(
    spark: SparkSession,
    root: str,
    domain: str,
    layer: str,
    where: Column | str | None = None,
    columns: list[str] | None = None,
    as_of: int | None = None,
    limit: int | None = None,
    catalog: str | None = None,
) -> DataFrame:
    """Scan a layer with a row filter, columns, an old snapshot and a limit; filter and columns reach the scan.

    ``root`` holds ``<domain>/<layer>`` folders. With ``catalog`` the layer is a table ``<catalog>.<domain>.<layer>``
    of a catalog that keeps snapshots itself.
    """
    if catalog:
        version = f" VERSION AS OF {int(as_of)}" if as_of is not None else ""
        df = spark.sql(f"SELECT * FROM `{catalog}`.`{domain}`.`{layer}`{version}")
    elif as_of is not None:
        df = versions.as_of(spark, f"{root}/{domain}/{layer}", as_of)
    else:
        df = spark.read.schema(contract(layer)).parquet(f"{root}/{domain}/{layer}")
    if where is not None:
        df = df.where(where)
    if columns:
        df = df.select(*[quoted(c) for c in columns])
    return df if limit is None else df.limit(limit)


def null_violations(df: DataFrame, layer: str) -> DataFrame:
    """``(field, nulls)`` for the required fields of a layer, in one pass."""
    fields = required(layer)
    counts = df.agg(*[F.count_if(quoted(f).isNull()).alias(f) for f in fields])
    return counts.unpivot([], [quoted(f) for f in fields], "field", "nulls")


def as_contract(df: DataFrame, layer: str) -> DataFrame:
    """Cast to a layer's columns, types and order."""
    return df.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in contract(layer).fields])


def read_contract(spark: SparkSession, path: str, layer: str, check: bool = True) -> DataFrame | None:
    """Parquet in the form of a layer's contract; ``None`` if there is no such file, an error if a required field is null."""
    try:
        df = as_contract(spark.read.parquet(path), layer)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if check and required(layer):
        broken = null_violations(df, layer).where("nulls > 0").collect()
        if broken:
            raise ValueError(f"{layer}: " + ", ".join(f"{r.nulls} null values of {r.field}" for r in broken))
    return df


_KEPT = (T.StringType, T.LongType, T.DoubleType, T.BooleanType, T.BinaryType)


def normalize_schema(df: DataFrame) -> DataFrame:
    """Types of tables built without a contract: integers widen to long, the rest is kept or refused; all nullable."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.IntegerType):
            out.append(quoted(field.name).cast("bigint").alias(field.name))
        elif isinstance(field.dataType, _KEPT):
            out.append(quoted(field.name))
        else:
            raise ValueError(f"Unsupported type: {field.dataType.simpleString()} of column {field.name}")
    return df.select(*out)


def read_partitioned_collection(spark: SparkSession, root: str, pattern: str, key: str) -> DataFrame:
    """Many Parquet files as one table of all their columns; ``key`` is what ``pattern`` captures from the file's path."""
    files = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    return files.withColumn(key, F.regexp_extract("_metadata.file_path", pattern, 1))
