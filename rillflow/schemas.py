"""Column contracts of the river-network tables.

Fixed values: column names, types and required fields of the published layers. Names hold ``.`` and ``=``, so
expressions over them need backticks.
"""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

_KINDS = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}

DOMAINS = ("ak_hf", "conus_hf", "gl_hf", "hi_hf", "prvi_hf")

CORE_LAYERS = ("network", "flowpaths", "nexus", "divides")

OPTIONAL_LAYERS = (
    "lakes",
    "divide-attributes",
    "flowpath-attributes",
    "flowpath-attributes-ml",
    "pois",
    "hydrolocations",
)

# VPUs a basin may reach into, for the VPUs whose basins are not contained in them.
UPSTREAM_VPUS = {"08": ("11", "10U", "10L", "08", "07", "05")}

ID_TYPES = ("hl_uri", "hf_id", "id", "poi_id")


def _fields(kind: str, *names: str, required: tuple[str, ...] = ()) -> list[StructField]:
    return [StructField(n, _KINDS[kind], n not in required) for n in names]


def _soil_layers(name: str) -> list[str]:
    return [f"{name}_soil_layers_stag={i}" for i in range(1, 5)]


_DIVIDE_ATTRIBUTE_NAMES = [
    *_soil_layers("mode.bexp"),
    "mode.ISLTYP",
    "mode.IVGTYP",
    *_soil_layers("geom_mean.dksat"),
    *_soil_layers("geom_mean.psisat"),
    "mean.cwpvt",
    "mean.mfsno",
    "mean.mp",
    "mean.refkdt",
    "mean.slope_1km",
    *_soil_layers("mean.smcmax"),
    *_soil_layers("mean.smcwlt"),
    "mean.vcmx25",
    "mean.Coeff",
    "mean.Zmax",
    "mode.Expon",
    "centroid_x",
    "centroid_y",
    "mean.impervious",
    "mean.elevation",
    "mean.slope",
    "circ_mean.aspect",
]

_CONTRACTS: dict[str, list[StructField]] = {
    "network": [
        *_fields("string", "id", "toid", "divide_id"),
        *_fields("double", "ds_id", "mainstem", "hydroseq"),
        *_fields("string", "hf_source"),
        *_fields("double", "hf_id", "lengthkm", "areasqkm", "tot_drainage_areasqkm"),
        *_fields("string", "type", "vpuid"),
        *_fields("double", "hf_hydroseq", "hf_lengthkm", "hf_mainstem"),
        *_fields("string", "topo"),
        *_fields("double", "poi_id"),
        *_fields("string", "hl_uri"),
    ],
    "flowpaths": [
        *_fields("string", "id", "toid", required=("id", "toid")),
        *_fields("double", "mainstem", "order"),
        *_fields("int", "hydroseq"),
        *_fields("double", "lengthkm", "areasqkm", "tot_drainage_areasqkm"),
        *_fields("boolean", "has_divide"),
        *_fields("string", "divide_id", "poi_id", "vpuid", required=("divide_id", "vpuid")),
        *_fields("binary", "geometry"),
    ],
    "nexus": [
        *_fields("string", "id", "toid", "type", "vpuid", required=("id", "toid", "vpuid")),
        *_fields("double", "poi_id"),
        *_fields("binary", "geometry"),
    ],
    "divides": [
        *_fields("string", "divide_id", "toid", "type", required=("divide_id",)),
        *_fields("double", "ds_id", "areasqkm"),
        *_fields("string", "vpuid", "id", required=("vpuid",)),
        *_fields("double", "lengthkm", "tot_drainage_areasqkm"),
        *_fields("boolean", "has_flowline"),
        *_fields("binary", "geometry"),
    ],
    "lakes": [
        *_fields("double", "lake_id", "LkArea", "LkMxE", "WeirC", "WeirL", "OrificeC", "OrificeA", "OrificeE", "WeirE", "ifd", "Dam_Length"),
        *_fields("string", "domain"),
        *_fields("int", "poi_id", required=("poi_id",)),
        *_fields("double", "hf_id", "reservoir_index_AnA", "reservoir_index_Extended_AnA", "reservoir_index_GDL_AK", "reservoir_index_Medium_Range", "reservoir_index_Short_Range"),
        *_fields("string", "res_id", "vpuid", required=("vpuid",)),
        *_fields("double", "lake_x", "lake_y"),
        *_fields("binary", "geometry"),
    ],
    "pois": [
        *_fields("int", "poi_id", required=("poi_id",)),
        *_fields("string", "id", "nex_id", "vpuid", required=("id", "nex_id", "vpuid")),
    ],
    "hydrolocations": [
        *_fields("int", "poi_id"),
        *_fields("string", "id", "nex_id", required=("id", "nex_id")),
        *_fields("double", "hf_id"),
        *_fields("string", "hl_link", "hl_reference", "hl_uri", "hl_source"),
        *_fields("double", "hl_x", "hl_y"),
        *_fields("string", "vpuid", required=("vpuid",)),
    ],
    "divide-attributes": [
        *_fields("string", "divide_id", required=("divide_id",)),
        *_fields("double", *_DIVIDE_ATTRIBUTE_NAMES),
        *_fields("string", "dist_4.twi", "vpuid", required=("vpuid",)),
    ],
    "flowpath-attributes": [
        *_fields("string", "link", "to"),
        *_fields("double", "Length_m", "Y", "n", "nCC", "BtmWdth", "TopWdth", "TopWdthCC", "ChSlp", "alt", "So", "MusX", "MusK"),
        *_fields("string", "gage", "gage_nex_id", "WaterbodyID", "waterbody_nex_id"),
        *_fields("string", "id", "toid", "vpuid", required=("id", "toid", "vpuid")),
    ],
    "flowpath-attributes-ml": [
        *_fields("string", "link", "to"),
        *_fields("double", "Length_m", "alt", "So", "MusX", "MusK"),
        *_fields("string", "gage", "gage_nex_id", "WaterbodyID", "waterbody_nex_id"),
        *_fields("string", "id", "toid", "vpuid", required=("id", "toid", "vpuid")),
        *_fields("double", "n", "BtmWdth", "TopWdth", "ChSlp", "nCC", "TopWdthCC", "Y", "YCC", "dingman_r"),
    ],
    "reference_flowpaths": [
        *_fields("string", "flowpath_id", "VPUID", "reachcode", required=("flowpath_id",)),
        *_fields("double", "frommeas", "tomeas"),
        *_fields("boolean", "burnline_event", "reversed"),
        *_fields("string", "source"),
        *_fields("double", "flowpath_toid", "lengthkm", "areasqkm", "totdasqkm", "terminalpa", "dnhydroseq", "hydroseq", "mainstemlp", "dnlevelpat", "pathlength", "terminalfl", "streamorder", "startflag"),
        *_fields("binary", "geometry"),
    ],
    "reference_divides": [
        *_fields("string", "divide_id", "vpuid", required=("divide_id",)),
        *_fields("double", "areasqkm", "has_flowpath"),
        *_fields("string", "flowpath_id"),
        *_fields("binary", "geometry"),
    ],
    "representative": [
        *_fields("string", "flowpath_id", required=("flowpath_id",)),
        *_fields("double", "r", "TW", "Y", "source_river_station", "river_station"),
        *_fields("string", "model", "ftype"),
        *_fields("double", "streamorde"),
        *_fields("binary", "geometry"),
        *_fields("string", "metdata_units"),
        *_fields("double", "epsg"),
        *_fields("string", "crs_units"),
        *_fields("double", "min_x", "min_y", "max_x", "max_y"),
    ],
    "conflated": [
        *_fields("double", "Ym", "TW"),
        *_fields("string", "flowpath_id", required=("flowpath_id",)),
        *_fields("double", "river_station"),
        *_fields("string", "model"),
        *_fields("double", "A", "r"),
        *_fields("string", "domain", "river_reach_rs", "source_river", "source_reach"),
        *_fields("double", "source_river_station"),
        *_fields("string", "station_elevation_points", "bank_stations", "metdata_units"),
        *_fields("double", "epsg"),
        *_fields("string", "crs_units", "ftype"),
        *_fields("double", "streamorde"),
        *_fields("binary", "geometry"),
        *_fields("double", "min_x", "min_y", "max_x", "max_y"),
    ],
    "snapshots": [
        *_fields("string", "domain", required=("domain",)),
        *_fields("bigint", "divide-attributes", "divides", "flowpath-attributes", "flowpath-attributes-ml", "flowpaths", "hydrolocations", "lakes", "network", "nexus", "pois"),
    ],
}


def contract(layer: str) -> StructType:
    """The schema of a layer, required fields marked non-nullable."""
    if layer not in _CONTRACTS:
        raise ValueError(f"unknown layer {layer!r}; known layers: {', '.join(_CONTRACTS)}")
    return StructType(_CONTRACTS[layer])


def required(layer: str) -> list[str]:
    """Names of the fields a layer must never leave null."""
    return [f.name for f in contract(layer).fields if not f.nullable]
