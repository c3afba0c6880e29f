"""Readers of observation, conflation, survey and parameter files."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.text import path_part, quoted
from rillflow.functions.times import to_naive_utc
from rillflow.plans.workspace import materialize

# Collection folder -> agency of the gauges in it.
GAGE_TYPES = {"ENVCA": "ENVCA", "CADWR": "CADWR", "USGS": "TXDOT"}

_SECTION = "struct<river:string,reach:string,xs_id:string,min_elevation:double,max_elevation:double>"
CONFLATION_TYPE = f"struct<reaches:map<string,struct<us_xs:{_SECTION},ds_xs:{_SECTION},network_to_id:string>>>"


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks for each core meanwhile, where Spark starts a task for each of 10,000 folders."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _few_tasks(files: DataFrame) -> DataFrame:
    """The rows of many small files, read by fewer tasks.

    Spark counts every file as some megabytes, so that small files are a task for each few of them, and a file or a
    part of an exchange each for what comes next. At most 32 of Spark's splits are put together.
    """
    splits = files.rdd.getNumPartitions()
    return files.coalesce(max(4 * files.sparkSession.sparkContext.defaultParallelism, splits // 32))


def newest_files(lines: DataFrame) -> DataFrame:
    """Of files with one name in several folders, the lines of the file in the last folder; ``path`` is the file's.

    The last folder is found over the files, not over their lines, so no file's lines are gathered to compare them.
    """
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    files = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    newest = files.groupBy(F.element_at(parts, -1).alias("file")).agg(F.max_by("path", folder).alias("path"))
    return lines.join(newest.select("path"), "path", "left_semi")


def _named(part: Column) -> Column:
    """A part of a path, without the column that a partitioned writer puts before it."""
    return F.regexp_replace(part, "^[^=/]*=", "")


def gage_observations(lines: DataFrame) -> DataFrame:
    """Lines ``(path, dateTime, ...)`` of files ``<type>/<collection>/<gauge>_*.csv`` to ``(id, gage_type, time, ...)``."""
    types = F.create_map(*[F.lit(v) for pair in GAGE_TYPES.items() for v in pair])
    name = F.regexp_replace(_named(path_part(F.col("path"), -1)), r"\.csv$", "")
    rest = [c for c in lines.columns if c not in ("path", "dateTime")]
    return newest_files(lines).select(
        F.split_part(name, F.lit("_"), F.lit(1)).alias("id"),
        F.try_element_at(types, _named(path_part(F.col("path"), -3))).alias("gage_type"),
        to_naive_utc(F.col("dateTime")).alias("time"),
        *rest,
    )


def read_gage_csvs(spark: SparkSession, root: str, schema: str, written: bool = False) -> DataFrame:
    """All gauge files under a folder; ``schema`` describes their columns, ``dateTime`` among them as text.

    With ``written`` a file is a folder of parts, as Spark writes them. Files are opened once: their lines are kept in
    the shared folder, as the newest files are found from them too.
    """
    lines = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "false")  # a header that differs from the schema fails
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv")
        .csv(root)
    )
    return gage_observations(materialize(_few_tasks(lines.select(_file(written).alias("path"), "*")), "gage-lines"))


def _file(written: bool) -> Column:
    """The path of the file that a row is from, or of the folder that Spark wrote it to."""
    path = F.col("_metadata.file_path")
    return F.regexp_replace(path, "/[^/]*$", "") if written else path


def parse_conflation(documents: DataFrame) -> DataFrame:
    """Conflation documents ``(path, value)`` to rows per reach; unreadable documents give none.

    Model and HUC are the folder names second and fourth from the end of the path. Only the linking fields are read.
    """
    parsed = documents.select(
        _named(path_part(F.col("path"), -2)).alias("model_id"),
        F.get(F.split(_named(path_part(F.col("path"), -4)), "_"), F.lit(1)).alias("huc"),
        F.from_json("value", CONFLATION_TYPE).alias("doc"),
    )
    reaches = parsed.select("model_id", "huc", F.posexplode("doc.reaches").alias("pos", "reach_id", "reach"))
    return reaches.select("model_id", "huc", "pos", "reach_id", "reach.us_xs", "reach.ds_xs", "reach.network_to_id")


def read_conflation_json(spark: SparkSession, root: str, written: bool = False) -> DataFrame:
    """All conflation files under a folder, one document per file, packed or not; one model's document is read whole.

    With ``written`` a document is a line of a file in a folder of its own, as Spark writes it.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*" if written else "*.{json,json.gz}")
    with _listing(spark):
        texts = reader.text(root, wholetext=not written)
    return parse_conflation(_few_tasks(texts.select(_file(written).alias("path"), "value")))


def numbered_lines(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, line_no, value)``: the lines of all files under a folder, numbered from 0 in each file.

    Files are read in splits, so a long one is many tasks' work. A line's place in its split follows from the order in
    which a task reads it; what the splits before it hold is counted once, a row for each split. Files are opened once,
    and their lines kept in the shared folder, as they are both counted and numbered.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    lines = reader.text(root).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        "value",
    )
    lines = materialize(lines, "lines")
    splits = lines.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before"))
    number = F.col("_before") + F.col("_at") - F.col("_first")
    return lines.join(splits, ["path", "_start"]).select("path", number.alias("line_no"), "value")


def _cells(line: Column) -> Column:
    """The cells of a CSV line: commas inside quotes do not separate, doubled quotes are one, empty cells are null."""
    cells = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    plain = F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), '""', '"'))
    return F.transform(plain, lambda c: F.nullif(c, F.lit("")))


def parse_marked_csv(lines: DataFrame, columns: dict[str, str], marker: str = "#SERIES DATA#") -> DataFrame:
    """``(path, row_no, ...columns)`` of files whose table starts with a header line after a marker line.

    ``lines`` is ``(path, line_no, value)``. ``columns`` maps header names to types; the order in the file does not
    matter and a line may have any number of cells. The header of each file is found among its lines and joined to the
    others, which stay where they are. A file without the marker, or whose header lacks a column, fails the query.
    """
    lines = lines.withColumn("value", F.regexp_replace("value", r"\r$", ""))
    marked = lines.groupBy("path").agg(F.min(F.when(F.col("value").contains(marker), F.col("line_no"))).alias("_marker"))
    missing = F.raise_error(F.concat(F.lit(f"{marker} not found in "), F.col("path"))).cast("bigint")
    marked = marked.select("path", F.coalesce("_marker", missing).alias("_marker"))
    rows = lines.join(marked, "path").where(F.col("line_no") > F.col("_marker"))
    header = rows.where(F.col("line_no") == F.col("_marker") + 1).select("path", _cells(F.col("value")).alias("_header"))

    def place(name: str) -> Column:
        at = F.array_position("_header", F.lit(name)).cast("int")
        absent = F.raise_error(F.concat(F.lit(f"no column {name} in "), F.col("path"))).cast("int")
        return F.when(at > 0, at - 1).otherwise(absent)

    places = header.select("path", *[place(n).alias(f"_at{i}") for i, n in enumerate(columns)])
    body = rows.where((F.col("line_no") > F.col("_marker") + 1) & (F.trim("value") != ""))
    body = body.join(places, "path").withColumn("_cells", _cells(F.col("value")))
    values = [F.get("_cells", F.col(f"_at{i}")).try_cast(kind).alias(n) for i, (n, kind) in enumerate(columns.items())]
    return body.select("path", (F.col("line_no") - F.col("_marker") - 2).alias("row_no"), *values)


def read_marked_csv(spark: SparkSession, root: str, columns: dict[str, str], marker: str = "#SERIES DATA#") -> DataFrame:
    """All such files under a folder; one file is one station's download, and may be larger than a task can hold."""
    return parse_marked_csv(materialize(numbered_lines(spark, root), "numbered-lines"), columns, marker)


def read_param_defaults(
    spark: SparkSession, root: str, glob: str = "*_params.csv", module: str = r"([^/]+)_params\.csv$"
) -> DataFrame:
    """Module default tables as one; ``module`` captures the module's name from the file's path.

    Headers differ between files, so each is read with its own and matched by name. There is one file per model.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    out = None
    for path in sorted(r.path for r in listing.load(root).select("path").collect()):
        table = spark.read.option("header", "true").csv(path)
        table = table.toDF(*[c.strip() for c in table.columns])
        found = re.search(module, path)
        table = table.select(
            F.lit(found.group(1) if found else path).alias("module"),
            F.monotonically_increasing_id().alias("pos"),
            *[quoted(c) for c in table.columns],
        )
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no {glob} under {root}")
    return out


# Size in bytes of the envelope in a GeoPackage geometry header, by its envelope code.
_ENVELOPE_BYTES = (0, 32, 48, 48, 64)


def _to_wkb(blob: bytes | None) -> bytes | None:
    """WKB without the GeoPackage header; null for an empty geometry."""
    if blob is None or blob[:2] != b"GP":
        return blob
    flags = blob[3]
    return None if flags & 0x10 else blob[8 + _ENVELOPE_BYTES[(flags >> 1) & 7] :]


def _read_layer_rows(content: bytes, layer: str, columns: list[str], geometry: str | None) -> Iterator[list[tuple]]:
    with sqlite3.connect(":memory:") as db:
        db.deserialize(content)
        if not db.execute("SELECT 1 FROM sqlite_master WHERE name = ? AND type IN ('table', 'view')", (layer,)).fetchone():
            return
        present = {row[1] for row in db.execute(f'PRAGMA table_info("{layer}")')}
        stored = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        names = [stored[0] if c == geometry and stored else c for c in columns]
        listed = ", ".join(f'"{n}"' if n in present else "NULL" for n in names)
        cursor = db.execute(f'SELECT {listed} FROM "{layer}"')
        while block := cursor.fetchmany(20_000):
            yield block


def gpkg_rows(files: DataFrame, layer: str, schema: T.StructType, geometry: str | None = "geometry") -> DataFrame:
    """Rows of one layer of GeoPackages ``(path, content)``, geometry as WKB; files without the layer give none."""
    columns = schema.names
    out = T.StructType([T.StructField("path", T.StringType()), *[T.StructField(f.name, f.dataType) for f in schema]])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for block in _read_layer_rows(content, layer, columns, geometry):
                    table = pd.DataFrame(block, columns=columns, dtype=object)
                    if geometry in columns:
                        table[geometry] = [_to_wkb(b) for b in table[geometry]]
                    table.insert(0, "path", path)
                    for field in schema:
                        if isinstance(field.dataType, (T.DoubleType, T.LongType, T.IntegerType)):
                            table[field.name] = pd.to_numeric(table[field.name])
                        elif isinstance(field.dataType, T.BooleanType):
                            table[field.name] = table[field.name].map(lambda v: None if v is None else bool(v))
                    yield table

    return files.select("path", "content").mapInPandas(read, out)


def read_gpkg_layers(
    spark: SparkSession, root: str, layer: str, schema: T.StructType, geometry: str | None = "geometry",
    distinct: bool = False,
) -> DataFrame:
    """One layer of all GeoPackages under a folder; ``distinct`` drops repeated rows, as survey exports hold them."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gpkg").load(root)
    )
    rows = gpkg_rows(files, layer, schema, geometry)
    return rows.dropDuplicates(schema.names) if distinct else rows
