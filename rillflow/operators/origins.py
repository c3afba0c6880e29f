"""Where a basin starts: network rows named by a gauge, reach or point of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.schemas import ID_TYPES, UPSTREAM_VPUS

ORIGIN_COLUMNS = ("id", "toid", "vpuid", "hydroseq", "poi_id", "hl_uri")


def _check_id_type(id_type: str) -> None:
    if id_type not in ID_TYPES:
        raise ValueError(f"id type {id_type!r} is not one of {', '.join(ID_TYPES)}; for a VPU use subset_vpu")


def origin_rows(network: DataFrame, id_type: str, identifiers: list | DataFrame | None = None) -> DataFrame:
    """Distinct origin rows of every identifier, as ``(identifier, id, toid, vpuid, hydroseq, poi_id, hl_uri)``.

    A short list becomes a pushed-down filter; a DataFrame of identifiers a semi-join; ``None`` takes all.
    """
    _check_id_type(id_type)
    rows = network.where(F.col(id_type).isNotNull())
    if isinstance(identifiers, DataFrame):
        rows = rows.join(identifiers.toDF(id_type), id_type, "left_semi")
    elif identifiers is not None:
        rows = rows.where(F.col(id_type).isin(list(identifiers)))
    return rows.select(F.col(id_type).alias("identifier"), *ORIGIN_COLUMNS).distinct()


def resolve_origins(candidates: DataFrame) -> DataFrame:
    """One origin per identifier: its row with the smallest hydroseq, a missing hydroseq coming first.

    ``ambiguous`` marks identifiers whose several rows all share one hydroseq; there is no basis to choose then.
    """
    row = F.struct("hydroseq", "id", "toid", "vpuid", "poi_id", "hl_uri")
    same = F.min("hydroseq").eqNullSafe(F.max("hydroseq")) & (
        (F.count("hydroseq") == 0) | (F.count("hydroseq") == F.count(F.lit(1)))
    )
    best = candidates.groupBy("identifier").agg(
        F.min(row).alias("best"), ((F.count(F.lit(1)) > 1) & same).alias("ambiguous")
    )
    return best.select("identifier", *[F.col(f"best.{c}").alias(c) for c in ORIGIN_COLUMNS], "ambiguous")


def find_origin(network: DataFrame, identifier, id_type: str = "hl_uri", return_all: bool = False) -> DataFrame:
    """The origin of one identifier (all its rows with ``return_all``); raises if there is none, or no single one."""
    candidates = origin_rows(network, id_type, [identifier]).drop("identifier")
    if candidates.isEmpty():
        raise ValueError(f"No origin found for {id_type}='{identifier}'")
    if return_all:
        return candidates
    resolved = resolve_origins(candidates.withColumn("identifier", F.lit("x")))
    if resolved.where("ambiguous").count():
        some = [r.id for r in candidates.select("id").distinct().orderBy("id").limit(20).collect()]
        raise ValueError(f"Multiple origins found: {some}")
    return resolved.drop("identifier", "ambiguous")


def vpu_scope(vpuid: str) -> list[str]:
    """VPUs that a basin starting in ``vpuid`` may reach into."""
    return list(UPSTREAM_VPUS.get(vpuid, (vpuid,)))


def vpu_filter(df: DataFrame, vpuid: str) -> DataFrame:
    """Rows of a VPU and those it may reach into; a static partition filter on layers written by VPU."""
    return df.where(F.col("vpuid").isin(vpu_scope(vpuid)))


def vpu_scope_column(vpuid):
    """Column form of :func:`vpu_scope`."""
    scope = F.array(vpuid)
    for wide, reach in UPSTREAM_VPUS.items():
        scope = F.when(vpuid == wide, F.array(*[F.lit(v) for v in reach])).otherwise(scope)
    return scope


def gages_in_domain(network: DataFrame) -> DataFrame:
    """Distinct stream-gauge URIs of a network."""
    return network.where(F.col("hl_uri").startswith("gages-")).select("hl_uri").distinct()


def min_hydroseq(network: DataFrame, by: str) -> DataFrame:
    """The most downstream row of each group: smallest hydroseq, ties by id."""
    lowest = F.min(F.struct("hydroseq", "id")).alias("lowest")
    picked = network.where(F.col("hydroseq").isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(lowest)
    return picked.select(by, "lowest.hydroseq", "lowest.id")
