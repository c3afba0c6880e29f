"""Exact ranks that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.text import columns_of
from rillflow.plans.frames import by_shuffle
from rillflow.plans.workspace import materialize


def with_rank(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """Add ``rank`` (1, 2, ... within the group, by ``order``) and ``group_rows``.

    The table is range-partitioned by group, ``order`` *and* a hash of the row, so neither a group nor a value that holds
    a third of the rows lands in one task; rows equal in ``order`` are ranked by the hash, alike on every run. A row's
    rank is its offset in its sorted partition plus the rows of the group in earlier partitions; only (group, partition)
    counts go through a window. The sorted table is written first, so a retried task cannot move rows between partitions.
    """
    ordered = _spread(df, group, order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(ordered, "ranked").withColumn("_part", F.shiftright("_at", 33))
    counts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0).cast("bigint")).alias("_before"),
        F.sum("_n").over(whole).alias("group_rows"),
    )
    return rows.join(_of_groups(offsets, group), (F.col("_part") == F.col("_p")) & _same_group(group)).select(
        *columns_of(df), (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("rank"), "group_rows"
    )


def running(df: DataFrame, group: list[str], order: list[str | Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with running aggregates: ``totals`` names each one and gives its kind, sum or max, and its column.

    A row's value covers the rows of its group up to and including it, by ``order`` and then a hash of the row; nulls
    add nothing. Rows are spread as for :func:`with_rank`; each partition's own part runs in a window of
    its rows, and what earlier partitions add comes from one row for each group and partition.
    """
    ordered = _spread(df, group, order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialize(ordered, "running").withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"sum": F.sum, "max": F.max}
    rows = rows.select("*", *[kinds[kind](column).over(inside).alias(f"_own_{name}") for name, (kind, column) in totals.items()])
    parts = rows.groupBy(*group, "_part").agg(*[F.max_by(f"_own_{name}", "_at").alias(f"_own_{name}") for name in totals])
    before = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)

    offsets = parts.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_part").alias("_p"),
        *[kinds[kind](f"_own_{name}").over(before).alias(f"_before_{name}") for name, (kind, _) in totals.items()],
    )

    def whole(name: str, kind: str) -> Column:
        own, earlier = F.col(f"_own_{name}"), F.col(f"_before_{name}")
        return F.coalesce(own + earlier if kind == "sum" else F.greatest(own, earlier), own, earlier).alias(name)

    joined = rows.join(_of_groups(offsets, group), (F.col("_part") == F.col("_p")) & _same_group(group))
    return joined.select(*columns_of(df), *[whole(name, kind) for name, (kind, _) in totals.items()])


def _spread(df: DataFrame, group: list[str], order: list[str | Column]) -> DataFrame:
    """Rows in range partitions, and sorted in them, by group, order and a hash of the whole row."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = [*[F.col(c) for c in group], *order, F.xxhash64(*hashed)]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _of_groups(offsets: DataFrame, group: list[str]) -> DataFrame:
    """Offsets of groups are as many as the groups; those of the whole table are a row for each partition."""
    return by_shuffle(offsets) if group else offsets


def _same_group(group: list[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return same


def row_index(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Number all rows 1..n in ``order`` without passing them through one task."""
    ranked = with_rank(df, [], order)
    return ranked.select(*columns_of(df), F.col("rank").alias(name))


def ntile_of(rank: Column, rows: Column, buckets: int) -> Column:
    """SQL ``ntile`` from a rank and the group's row count: the first ``rows % buckets`` tiles hold one more row."""
    size, extra = F.floor(rows / buckets), rows % buckets
    in_long = rank <= extra * (size + 1)
    long_tile = F.ceil(rank / (size + 1))
    short_tile = extra + F.ceil((rank - extra * (size + 1)) / size)
    return F.when(in_long, long_tile).otherwise(short_tile).cast("int")
