"""Streamflow series: ranges, coverage, reshaping and 15-minute slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions.text import columns_of, quoted, safe_name
from rillflow.functions.times import MICROS, clock_text, epoch_micros, from_epoch_micros, parse_time_strict
from rillflow.plans.workspace import materialize

RELEASE_ITEM = {
    "parameterGroup": "Lake/Reservoir Outflow",
    "parameterName": "Lake/Reservoir Release - Total",
    "parameterUnit": "cfs",
}


class NoResults(Exception):
    """No observation matches the request."""


def unpivot_observations(wide: DataFrame) -> DataFrame:
    """One column per gauge to rows ``(time, id, q_cms)``."""
    gages = [quoted(c) for c in wide.columns if c != "time"]
    return wide.unpivot(["time"], gages, "id", "q_cms")


def gage_column(wide: DataFrame, gage: str) -> DataFrame:
    """``time`` and one gauge of a wide table."""
    return wide.select("time", quoted(gage))


def _bound(time) -> Column:
    if isinstance(time, Column):
        return time
    return parse_time_strict(F.lit(time)) if isinstance(time, str) else F.lit(time).cast("timestamp_ntz")


def streamflow_range(flow: DataFrame, gages: str | list[str], start=None, end=None) -> DataFrame:
    """Observed flow of a gauge (or several) between two times, both ends included; None leaves an end open.

    Times are timestamps, Columns or text in a spelling that :func:`parse_time_strict` reads, where a year, month, day
    or hour alone means its start; other text fails the query. Conditions on plain columns, so they reach the scan.
    """
    wanted = F.col("id") == gages if isinstance(gages, str) else F.col("id").isin(gages)
    if start is not None:
        wanted = wanted & (F.col("time") >= _bound(start))
    if end is not None:
        wanted = wanted & (F.col("time") <= _bound(end))
    return flow.where(wanted & F.col("q_cms").isNotNull())


def streamflow_request(flow: DataFrame, gage: str, start=None, end=None) -> DataFrame:
    """A gauge's range as a download: raises when empty, and drops the second series when it holds nothing."""
    rows = streamflow_range(flow, gage, start, end)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count("q_cms_denoted_3").alias("second")).first()
    if not found.n:
        raise NoResults(f"gauge {gage} has no flow between these times")
    columns = ["time", "q_cms"] + (["q_cms_denoted_3"] if found.second else [])
    return rows.select(*columns)


def streamflow_info(flow: DataFrame) -> DataFrame:
    """Per gauge: observed records, first and last observed time, estimated megabytes as CSV and as Parquet."""
    n = F.count("q_cms")
    observed = F.when(F.col("q_cms").isNotNull(), F.col("time"))
    megabyte = 1024 * 1024
    return flow.groupBy("id").agg(
        n.alias("total_records"),
        F.min(observed).alias("start_time"),
        F.max(observed).alias("end_time"),
        F.round(n * 25 / megabyte, 2).alias("csv_mb"),
        F.round(n * 8 / megabyte, 2).alias("parquet_mb"),
    )


def streamflow_available(flow: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The first ``limit`` gauge ids in order, and how many there are."""
    ids = flow.select("id").distinct()
    return ids.orderBy("id").limit(limit), ids.count()


def gage_file_name(gage: Column) -> Column:
    """A gauge id as a file name."""
    return safe_name(gage)


def with_neighbours(df: DataFrame, key: str, time: str) -> DataFrame:
    """Add ``prev_time`` and ``next_time`` of each observation in its series.

    A window over a whole series would hold the longest series in one task. Observations are compared within
    calendar months, and only the first and last time of each month are compared across months.
    """
    month = F.date_format(time, "yyyy-MM")
    dated = df.withColumn("_month", month)
    per_month = Window.partitionBy(key, "_month").orderBy(time)
    inner = dated.withColumn("_prev", F.lag(time).over(per_month)).withColumn("_next", F.lead(time).over(per_month))
    months = dated.groupBy(key, "_month").agg(F.min(time).alias("_first"), F.max(time).alias("_last"))
    per_key = Window.partitionBy(key).orderBy("_month")
    edges = months.select(
        key,
        "_month",
        F.lag("_last").over(per_key).alias("_before"),
        F.lead("_first").over(per_key).alias("_after"),
    )
    return inner.join(edges, [key, "_month"]).select(
        *columns_of(df), F.coalesce("_prev", "_before").alias("prev_time"), F.coalesce("_next", "_after").alias("next_time")
    )


def upsample_daily_nearest(
    observations: DataFrame, key: str = "id", time: str = "time", step_minutes: int = 15
) -> DataFrame:
    """Daily observations on a regular grid, each grid time taking the nearest observation (the later on a tie).

    The grid of a series runs from the start of its first day to the end of its last. Every observation generates
    the grid times it is nearest to, so nothing is searched. Series that are not daily fail the query. The observations
    are written once, because their neighbours are found in two groupings.
    """
    step = step_minutes * 60 * MICROS
    day = 86400 * MICROS

    def ceil_steps(value: Column, unit: int) -> Column:
        return F.floor((value + (unit - 1)) / F.lit(unit)).cast("bigint")

    daily = observations
    if "timestep" in observations.columns:
        other = F.raise_error(F.concat(F.lit("only daily series can be refined, this one is: "), F.col("timestep")))
        ok = F.when(F.col("timestep") == "daily", F.col(time)).otherwise(other.cast("timestamp_ntz"))
        daily = observations.withColumn(time, ok)
    near = with_neighbours(materialize(daily, "daily"), key, time).withColumn("_t", epoch_micros(F.col(time)))
    prev, after = epoch_micros(F.col("prev_time")), epoch_micros(F.col("next_time"))
    own_day = F.floor(F.col("_t") / F.lit(day)).cast("bigint") * day
    first = F.coalesce(ceil_steps(prev + F.col("_t"), 2 * step), ceil_steps(own_day, step))
    beyond = F.coalesce(ceil_steps(F.col("_t") + after, 2 * step), ceil_steps(own_day + day, step))
    near = near.withColumns({"_first": first, "_beyond": beyond}).where("_beyond > _first")
    ends = [from_epoch_micros(c * step) for c in (F.col("_first"), F.col("_beyond") - 1)]
    grid = near.withColumn("_time", F.explode(F.sequence(*ends, F.make_dt_interval(mins=F.lit(step_minutes)))))
    rest = [c for c in observations.columns if c not in (key, time)]
    return grid.select(key, F.col("_time").alias(time), *rest)


def timeslice_rows(grid: DataFrame, key: str = "id", time: str = "time", flow: str = "result") -> DataFrame:
    """15-minute slices for routing: station, time text, discharge, quality and query time."""
    return grid.select(
        F.col(key).cast("string").alias("stationId"),
        clock_text(F.col(time)).alias("time"),
        F.col(flow).alias("discharge"),
        F.lit(100).alias("discharge_quality"),
        F.unix_seconds(F.current_timestamp()).cast("int").alias("queryTime"),
    )


def valid_release_items(items: DataFrame) -> DataFrame:
    """Catalogue items that are total reservoir releases in cfs."""
    condition = F.lit(True)
    for column, value in RELEASE_ITEM.items():
        condition = condition & (F.col(column) == value)
    return items.where(condition)


def single_release_item(items: DataFrame):
    """The one release item of a location; raises if there is none or more than one."""
    found = valid_release_items(items).limit(2).collect()
    if not found:
        raise ValueError("the location lists no total release")
    if len(found) > 1:
        raise ValueError("the location lists several total releases")
    return found[0]


def append_rows(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns matched by name and missing ones null."""
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged
