"""Writers."""

from __future__ import annotations

import gzip
import logging
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter
from uuid import uuid4

from pyarrow import ArrowInvalid, ArrowNotImplementedError
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from rillflow.functions.text import quoted

log = logging.getLogger(__name__)


def _balanced(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of one output folder together in few tasks, large folders split over several, by adaptive execution."""
    return df.hint("rebalance", *[quoted(c) for c in columns])


def many_files(df: DataFrame, folders: list[str], order: str | None = None) -> DataFrameWriter:
    """A writer of a folder for each value of ``folders``, its rows by ``order``, a column that is not written.

    A small file costs by being made and not by its bytes, so files are dealt out to all cores by number, where rows
    gathered by size would leave them to a few tasks. Each task moves its own files to their place; otherwise the driver
    would, one after the other.
    """
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *folders)
    if order is not None:
        dealt = dealt.sortWithinPartitions(*folders, order).drop(order)
    return dealt.write.partitionBy(*folders).option("mapreduce.fileoutputcommitter.algorithm.version", "2")


def arrow_opens(root: str) -> bool:
    """Whether tasks can write files under ``root`` by Arrow, which knows fewer stores than Spark does."""
    try:
        FileSystem.from_uri(root)
    except (ArrowInvalid, ArrowNotImplementedError, OSError):
        return False
    return True


def _blocks(lines: Iterable[str], size: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends, put together to blocks of about ``size`` characters."""
    block, length = [], 0
    for line in lines:
        block += (line, "\n")
        length += len(line) + 1
        if length >= size:
            yield "".join(block).encode()
            block, length = [], 0
    yield "".join(block).encode()


def _write_file(store: FileSystem, path: str, lines: Iterable[str]) -> None:
    """One file, which has its name only once it is whole; readers pass over names that begin with an underscore."""
    folder, _, name = path.rpartition("/")
    begun = f"{folder}/_{name}.{uuid4().hex}"
    try:
        raw = store.open_output_stream(begun, compression=None)
    except FileNotFoundError:
        store.create_dir(folder)
        raw = store.open_output_stream(begun, compression=None)
    with raw:
        if name.endswith(".gz"):
            with gzip.GzipFile("", "wb", 6, raw, 0) as packed:
                packed.writelines(_blocks(lines))
        else:
            for block in _blocks(lines):
                raw.write(block)
    try:
        store.move(begun, path)
    except OSError:  # a store that does not replace a file, which an earlier attempt of the task wrote
        store.delete_file(path)
        store.move(begun, path)


def _write_files(rows: Iterable[tuple[str, str]], root: str, header: list[str]) -> None:
    store, base = FileSystem.from_uri(root)
    for path, run in groupby(rows, itemgetter(0)):
        _write_file(store, f"{base}/{path}", (line for lines in (header, map(itemgetter(1), run)) for line in lines))


def _place_name(place: str) -> Column:
    """A value as a part of a path; one that is missing, or that readers would pass over, as Spark's writer names it."""
    value = F.coalesce(F.nullif(F.col(place).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    value = F.replace(value, F.lit("/"), F.lit("%2F"))
    return F.when(value.rlike("^[_.]"), F.concat(F.lit(f"{place}="), value)).otherwise(value)


def named_files(rows: DataFrame, places: list[str], root: str, header: str | None = None, whole: bool = False) -> None:
    """A file ``<root>/<place>/...`` for each value of ``places``, the last of which is its name, of the lines ``value``.

    Each file begins with ``header``; a name that ends in ``.gz`` is packed. Tasks write the files themselves, line by
    line and by Arrow: Spark's writer takes a folder, a checksum file and, on a local disk, three processes that set
    permissions for every file. With ``whole`` a file is one row, and rows stay where they are.
    """
    lines = rows.select(F.concat_ws("/", *map(_place_name, places)).alias("path"), "value")
    if not whole:
        lines = lines.repartition("path").sortWithinPartitions("path")
    lines.foreachPartition(partial(_write_files, root=root, header=[] if header is None else [header]))


def write_layers(layers: dict[str, DataFrame], out: str) -> list[str]:
    """Each layer that has rows to ``out/<layer>``; names of those written.

    A layer's plan runs once; whether it has rows is told by what was written, and an empty folder is taken away.
    """
    written = []
    for name, df in layers.items():
        path, spark = f"{out}/{name}", df.sparkSession
        df.write.mode("overwrite").parquet(path)
        if spark.read.schema(df.schema).parquet(path).isEmpty():
            log.warning("%s has no rows and is not written", name)
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            continue
        written.append(name)
    return written


def write_timeseries(df: DataFrame, path: str, fmt: str = "csv", header: bool = True) -> None:
    """CSV with ``yyyy-MM-dd HH:mm:ss`` times, or LZ4 Parquet."""
    if fmt == "csv":
        writer = df.write.mode("overwrite").option("header", str(header).lower())
        writer.option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
        ).csv(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").option("compression", "lz4").parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}; csv or parquet")


def write_vpu_partitioned(df: DataFrame, path: str, column: str = "vpuid", mode: str = "append") -> None:
    """A layer in folders by VPU, for static pruning."""
    _balanced(df, column).write.mode(mode).partitionBy(column).parquet(path)


def build_table_if_absent(df: DataFrame, path: str) -> None:
    """Write a table once; nothing happens if it exists."""
    df.write.mode("ignore").parquet(path)


def write_xs_by_huc(xs: DataFrame, path: str) -> None:
    """Cross-sections in folders by HUC, the two elevations as text."""
    text = {c: F.col(c).cast("string") for c in ("thalweg", "xs_max_elevation")}
    _balanced(xs.withColumns(text), "huc").write.mode("overwrite").partitionBy("huc").parquet(path)


def write_xs_by_river(xs: DataFrame, path: str) -> None:
    """Cross-sections in folders by HUC and river."""
    _balanced(xs, "huc", "river").write.mode("overwrite").partitionBy("huc", "river").parquet(path)


def place_code(x: Column, y: Column, extent: tuple[float, float, float, float]) -> Column:
    """A place's number on a curve that keeps near places near (Morton order), for places in (west, south, east, north).

    Both coordinates are counted in 65,536 steps, and the bits of the two counts alternate.
    """

    def spread(value: Column, low: float, high: float) -> Column:
        part = (value.cast("double") - low) / (high - low or 1.0)
        bits = F.floor(F.greatest(F.least(part, F.lit(1.0)), F.lit(0.0)) * 65_535).cast("bigint")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return bits

    west, south, east, north = extent
    return spread(x, west, east).bitwiseOR(F.shiftleft(spread(y, south, north), 1))


def write_xs_by_place(xs: DataFrame, path: str, row_group_bytes: int = 8 << 20, mode: str = "overwrite") -> None:
    """Cross-sections in the order of their places, so that a box reads the row groups near it and skips the others.

    The four bounds of a section are columns with statistics in every row group, and a range filter on them is pushed to
    the scan. Rows are range-partitioned by place and a hash, so a spot with very many sections is several files.
    """
    extent = xs.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    extent = tuple(float(v or 0) for v in extent)
    code = place_code((F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2, extent)
    order = [code, F.xxhash64("min_x", "min_y", "max_x", "max_y")]
    placed = xs.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path)


def replace_or_append(frames: list[DataFrame], path: str, overwrite: bool, max_rows_per_file: int = 500_000) -> None:
    """Load frames with columns matched by name, replacing or extending a table, in files of bounded size."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    writer = merged.write.mode("overwrite" if overwrite else "append")
    writer.option("maxRecordsPerFile", max_rows_per_file).parquet(path)
