"""Queries on model parameters, configuration documents, tables with snapshots, readers and writers."""

from __future__ import annotations

import sqlite3
import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow import sinks
from rillflow.catalogue import testdata as td
from rillflow.catalogue.network import _BASINS, basins
from rillflow.catalogue.registry import query, rounded
from rillflow.catalogue.sections import sections
from rillflow.catalogue.series import LAT_SQL, LON_SQL
from rillflow.operators import bmi, params, versions
from rillflow.plans.workspace import new_path
from rillflow.schemas import contract
from rillflow.sources import files, tables

ATTRIBUTES = "divide-attributes"


def subset(spark, sf):
    return basins(spark, sf, [ATTRIBUTES])


def calibrated(spark, sf):
    return td.view(spark, sf, "sac_params")


# The basins' SQL continues with the calibrated parameters.
_SQL = _BASINS.replace("WITH RECURSIVE ", td.ctes("sac_params", recursive=True) + ",\n", 1)


def _sum_mean(name: str) -> str:
    columns = [f'"{name}_soil_layers_stag={i}"' for i in range(1, 5)]
    total = " + ".join(f"coalesce({c}, 0)" for c in columns)
    present = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in columns)
    return f"(({total}) / ({present}))"


_SOIL = f"{_sum_mean('mean.smcmax')} AS smcmax, {_sum_mean('mode.bexp')} AS b, {_sum_mean('geom_mean.psisat')} AS satpsi"
_ROUNDED_SOIL = "round(smcmax, 6) AS smcmax, round(b, 6) AS b, round(satpsi, 6) AS satpsi"


@query("layer_mean", td.ctes(ATTRIBUTES) + f", m AS (SELECT divide_id, {_SOIL} FROM divide_attributes) SELECT divide_id, {_ROUNDED_SOIL} FROM m")
def layer_mean(spark, sf):
    attributes = td.view(spark, sf, ATTRIBUTES)
    means = {"smcmax": "mean.smcmax", "b": "mode.bexp", "satpsi": "geom_mean.psisat"}
    return rounded(attributes.select("divide_id", *[params.layer_mean(attributes, p).alias(n) for n, p in means.items()]))


@query(
    "prefix_columns",
    td.ctes(ATTRIBUTES)
    + """ SELECT divide_id, "mean.smcwlt_soil_layers_stag=1", "mean.smcwlt_soil_layers_stag=2",
  "mean.smcwlt_soil_layers_stag=3", "mean.smcwlt_soil_layers_stag=4", "mean.slope", 0::DOUBLE AS absent FROM divide_attributes""",
)
def prefix_columns(spark, sf):
    attributes = td.view(spark, sf, ATTRIBUTES)
    names = params.prefix_columns(attributes, "mean.smcwlt")
    return attributes.select(
        "divide_id",
        *[F.col(f"`{n}`") for n in names],
        params.column_or_zero(attributes, "mean.slope").alias("mean.slope"),
        params.column_or_zero(attributes, "no such column").alias("absent"),
    )


@query("drop_and_rename", td.ctes("sac_params") + " SELECT divide_id, b01 AS jan_temp_range, b12 AS dec_temp_range FROM sac_params")
def drop_and_rename(spark, sf):
    table = calibrated(spark, sf).select("divide_id", "b01", "b12", "mfmax")
    return params.drop_and_rename(table, ["mfmax"], {"b01": "jan_temp_range", "b12": "dec_temp_range"})


@query(
    "left_equi",
    td.ctes(ATTRIBUTES, "divides")
    + """ SELECT a.divide_id, a."mean.slope", d.areasqkm FROM divide_attributes a
LEFT JOIN (SELECT * FROM divides WHERE vpuid = '01') d ON d.divide_id = a.divide_id""",
)
def left_equi(spark, sf):
    attributes = td.view(spark, sf, ATTRIBUTES).select("divide_id", F.col("`mean.slope`"))
    divides = td.view(spark, sf, "divides").where("vpuid = '01'").select("divide_id", "areasqkm")
    return params.left_equi(attributes, divides)


@query(
    "override_join",
    td.ctes("sac_params", "divides")
    + " SELECT d.divide_id, d.areasqkm, s.uzk, s.pfree FROM divides d JOIN sac_params s ON s.divide_id = d.divide_id",
)
def override_join(spark, sf):
    base = td.view(spark, sf, "divides").select("divide_id", "areasqkm", F.lit(0.3).alias("uzk"), F.lit(0.1).alias("pfree"))
    return params.override_join(base, calibrated(spark, sf).select("divide_id", "uzk", "pfree"), ["uzk", "pfree"])


@query("twi_bins", td.ctes(ATTRIBUTES) + """ SELECT divide_id, 2::BIGINT AS bins, CAST("dist_4.twi"::JSON->0->'v' AS DOUBLE) AS v,
  CAST("dist_4.twi"::JSON->1->'frequency' AS DOUBLE) AS frequency FROM divide_attributes""")
def twi_bins(spark, sf):
    bins = params.twi_bins(F.col("`dist_4.twi`"))
    table = td.view(spark, sf, ATTRIBUTES).select("divide_id", bins.alias("b"))
    return table.select("divide_id", F.size("b").cast("bigint").alias("bins"), F.expr("b[0].v").alias("v"), F.expr("b[1].frequency").alias("frequency"))


_SFT = f"SELECT basin, divide_id AS catchment, {_SOIL} FROM attrs"


@query("params_sft", _SQL + f"SELECT basin, catchment, {_ROUNDED_SOIL}, 'Xinanjiang' AS ice_fraction_scheme, '1.[d]' AS end_time FROM ({_SFT})")
def params_sft(spark, sf):
    rows = params.params_sft(subset(spark, sf))
    return rounded(rows.select("basin", "catchment", "smcmax", "b", "satpsi", "ice_fraction_scheme", "end_time"))


@query(
    "params_smp",
    _SQL
    + f"""SELECT basin, catchment, {_ROUNDED_SOIL}, 'layered' AS soil_storage_model, 'NA' AS soil_storage_depth,
  'constant' AS soil_moisture_profile_option, '2.0' AS soil_depth_layers, '10[m]' AS water_table_depth,
  'NA' AS water_table_based_method FROM ({_SFT})""",
)
def params_smp(spark, sf):
    return rounded(params.params_smp(subset(spark, sf), "LASAM").drop("verbosity", "soil_z", "soil_moisture_fraction_depth"))


_SNOW = f"""SELECT a.basin, a.divide_id AS catchment, d.areasqkm AS hru_area, round({LAT_SQL}, 6) AS latitude,
  round(a."mean.elevation" * 0.01, 6) AS elev"""
_AREA = "JOIN divs d ON d.basin = a.basin AND d.divide_id = a.divide_id"


@query("params_snow17", _SQL + _SNOW + f", 1.0::DOUBLE AS mf_max, 0.2::DOUBLE AS mf_min, 0.05::DOUBLE AS uadj FROM attrs a LEFT {_AREA}")
def params_snow17(spark, sf):
    columns = ["basin", "catchment", "hru_area", "latitude", "elev", "mf_max", "mf_min", "uadj"]
    return rounded(params.params_snow17(subset(spark, sf)).select(*columns))


@query(
    "params_snow17_conus",
    _SQL + _SNOW + f""", round(s.mfmax, 6) AS mf_max, round(s.mfmin, 6) AS mf_min, round(s.uadj, 6) AS uadj FROM attrs a
LEFT {_AREA} JOIN sac_params s ON s.divide_id = a.divide_id""",
)
def params_snow17_conus(spark, sf):
    columns = ["basin", "catchment", "hru_area", "latitude", "elev", "mf_max", "mf_min", "uadj"]
    return rounded(params.params_snow17(subset(spark, sf), calibrated(spark, sf)).select(*columns))


@query(
    "params_lstm",
    _SQL
    + f"""SELECT a.basin, a.divide_id AS catchment, a."mean.slope" AS slope_mean, round(a."mean.elevation" * 0.01, 6) AS elev_mean,
  d.areasqkm AS area_sqkm, round({LON_SQL}, 6) AS lon, round({LAT_SQL}, 6) AS lat, a.basin AS basin_id, '1 hour' AS timestep
FROM attrs a LEFT {_AREA}""",
)
def params_lstm(spark, sf):
    return rounded(params.params_lstm(subset(spark, sf)).drop("basin_name", "inital_state", "train_cfg_file", "verbose"))


@query("params_lasam", _SQL + """SELECT basin, divide_id AS catchment, "mode.ISLTYP" AS layer_soil_type, true AS sft_coupled FROM attrs""")
def params_lasam(spark, sf):
    return params.params_lasam(subset(spark, sf), True).select("basin", "catchment", "layer_soil_type", "sft_coupled")


@query(
    "params_noah_owp",
    _SQL
    + f"""SELECT basin, divide_id AS catchment, "mean.slope" AS terrain_slope, "circ_mean.aspect" AS azimuth,
  round({LON_SQL}, 6) AS lon, round({LAT_SQL}, 6) AS lat, "mode.ISLTYP" AS isltyp, CAST("mode.IVGTYP" AS INTEGER) AS vegtyp,
  CASE WHEN "mode.IVGTYP" = 16 THEN 2 ELSE 1 END AS sfctyp FROM attrs""",
)
def params_noah_owp(spark, sf):
    columns = ["basin", "catchment", "terrain_slope", "azimuth", "lon", "lat", "isltyp", "vegtyp", "sfctyp"]
    return rounded(params.params_noah_owp(subset(spark, sf)).select(*columns))


@query(
    "params_sacsma",
    _SQL
    + """SELECT d.basin, d.divide_id AS catchment, d.areasqkm AS hru_area, round(s.uztwm, 6) AS uztwm, s.lzfpm, s.zperc,
  round(s.rexp, 6) AS rexp, 0.3::DOUBLE AS rserv FROM divs d JOIN sac_params s ON s.divide_id = d.divide_id""",
)
def params_sacsma(spark, sf):
    rows = params.params_sacsma(subset(spark, sf), calibrated(spark, sf))
    return rounded(rows.select("basin", "catchment", "hru_area", "uztwm", "lzfpm", "zperc", "rexp", "rserv"))


@query(
    "params_sacsma_defaults",
    _SQL
    + """SELECT basin, divide_id AS catchment, areasqkm AS hru_area, 75::DOUBLE AS uztwm, 300::DOUBLE AS lzfpm,
  100::DOUBLE AS zperc, 0.3::DOUBLE AS uzk FROM divs""",
)
def params_sacsma_defaults(spark, sf):
    return params.params_sacsma(subset(spark, sf)).select("basin", "catchment", "hru_area", "uztwm", "lzfpm", "zperc", "uzk")


_TROUTE_NET = """'{''supernetwork_parameters'': {''geo_file_path'': ''gauge_' || basin || '.gpkg''}, ''waterbody_parameters'': {''level_pool'': {''level_pool_waterbody_parameter_file_path'': ''gauge_' || basin || '.gpkg''}}}'"""


@query("params_troute", _SQL + f"SELECT basin, divide_id AS catchment, {_TROUTE_NET} AS nwtopo_param FROM attrs")
def params_troute(spark, sf):
    return params.params_troute(subset(spark, sf)).select("basin", "catchment", "nwtopo_param")


@query(
    "params_topmodel",
    _SQL
    + f"""SELECT a.basin, a.divide_id AS catchment, 2 AS num_topodex_values, round_even(d.lengthkm * 1000, 0) AS dist_from_outlet,
  CAST("dist_4.twi"::JSON->1->'v' AS DOUBLE) AS second_v FROM attrs a LEFT {_AREA}""",
)
def params_topmodel(spark, sf):
    rows = params.params_topmodel(subset(spark, sf))
    return rows.select("basin", "catchment", "num_topodex_values", "dist_from_outlet", F.expr("twi[1].v").alias("second_v"))


@query(
    "params_ueb",
    _SQL
    + f"""SELECT a.basin, a.divide_id AS catchment, a."mean.slope" AS slope, a."circ_mean.aspect" AS aspect,
  round("mean.elevation" * 0.01, 6) AS elevation, round({LON_SQL}, 6) AS longitude, round({LAT_SQL}, 6) AS latitude,
  round(s.b01, 6) AS jan_temp_range, round(s.b12, 6) AS dec_temp_range
FROM attrs a JOIN sac_params s ON s.divide_id = a.divide_id""",
)
def params_ueb(spark, sf):
    rows = params.params_ueb(subset(spark, sf), calibrated(spark, sf))
    columns = "basin catchment slope aspect elevation longitude latitude jan_temp_range dec_temp_range".split()
    return rounded(rows.select(*columns))


_CFE_SQL = """SELECT a.basin, a.divide_id AS catchment, "mode.bexp_soil_layers_stag=1" AS soil_params_b,
  "geom_mean.dksat_soil_layers_stag=1" AS soil_params_satdk, "mean.Zmax" AS max_gw_storage, "mode.Expon" AS expon,
  'Xinanjiang' AS surface_partitioning_scheme, CAST("x_Xinanjiang_shape_parameter" AS VARCHAR) AS x_shape
FROM attrs a JOIN sac_params s ON s.divide_id = a.divide_id"""


@query("params_cfe", _SQL + _CFE_SQL)
def params_cfe(spark, sf):
    rows = params.params_cfe(subset(spark, sf), calibrated(spark, sf), "CFE-X")
    return rows.select(
        "basin",
        "catchment",
        "soil_params_b",
        "soil_params_satdk",
        "max_gw_storage",
        "expon",
        "surface_partitioning_scheme",
        F.col("x_Xinanjiang_shape_parameter").alias("x_shape"),
    )


def _document(module: str, lines: list[str], source: str) -> str:
    content = " || chr(10) || ".join(lines)
    return (
        _SQL
        + f"""SELECT basin, catchment, '{module}' AS module, catchment || '_bmi_config_{module}.txt' AS file_name,
  {content} AS content FROM ({source})"""
    )


def _line(label: str, expression: str, unit: str = "", sep: str = "=") -> str:
    tail = f" || '{unit}'" if unit else ""
    return f"'{label}{sep}' || CAST({expression} AS VARCHAR){tail}"


_TEMP = ",".join([str((45 - 32) * 5 / 9 + 273.15)] * 4)


@query(
    "render_bmi_sft",
    _document(
        "sft",
        [
            "'verbosity=none'",
            "'soil_moisture_bmi=1'",
            "'end_time=1.[d]'",
            "'dt=1.0[h]'",
            _line("soil_params.smcmax", "smcmax"),
            _line("soil_params.b", "b"),
            _line("soil_params.satpsi", "satpsi"),
            "'soil_params.quartz=1.0'",
            "'ice_fraction_scheme=Schaake'",
            "'soil_z=0.1,0.3,1.0,2.0[m]'",
            f"'soil_temperature={_TEMP}[K]'",
        ],
        _SFT,
    ),
)
def render_sft(spark, sf):
    return bmi.render_bmi_configs(params.params_sft(subset(spark, sf), use_schaake=True), "sft")


@query(
    "render_bmi_smp",
    _document(
        "smp",
        [
            "'verbosity=none'",
            _line("soil_params.smcmax", "smcmax"),
            _line("soil_params.b", "b"),
            _line("soil_params.satpsi", "satpsi"),
            "'soil_z=0.1,0.3,1.0,2.0[m]'",
            "'soil_moisture_fraction_depth=0.4[m]'",
        ],
        _SFT,
    ),
)
def render_smp(spark, sf):
    return bmi.render_bmi_configs(params.params_smp(subset(spark, sf), "CFE-S"), "smp")


_SACSMA_TEXT = (
    "uztwm: 75.0,uzfwm: 30.0,lztwm: 150.0,lzfpm: 300.0,lzfsm: 150.0,adimp: 0.0,uzk: 0.3,lzpk: 0.01,lzsk: 0.1,"
    "zperc: 100.0,rexp: 2.0,pctim: 0.0,pfree: 0.1,riva: 0.0,side: 0.0,rserv: 0.3"
)


@query(
    "render_bmi_sacsma",
    _document(
        "sacsma",
        [
            _line("hru_id", "catchment", sep=": "),
            _line("hru_area", "areasqkm", sep=": "),
            *[f"'{line}'" for line in _SACSMA_TEXT.split(",")],
        ],
        "SELECT basin, divide_id AS catchment, areasqkm FROM divs",
    ),
)
def render_sacsma(spark, sf):
    return bmi.render_bmi_configs(params.params_sacsma(subset(spark, sf)), "sacsma")


@query(
    "render_bmi_troute",
    _document(
        "troute",
        [
            "'bmi_parameters: " + str(params.TROUTE_BMI).replace("'", "''") + "'",
            "'log_parameters: {''showtiming'': True, ''log_level'': ''DEBUG''}'",
            f"'network_topology_parameters: ' || {_TROUTE_NET}",
            "'compute_parameters: " + str(params.TROUTE_COMPUTE).replace("'", "''") + "'",
            "'output_param: " + str(params.TROUTE_OUTPUT).replace("'", "''") + "'",
        ],
        "SELECT basin, divide_id AS catchment FROM attrs",
    ),
)
def render_troute(spark, sf):
    return bmi.render_bmi_configs(params.params_troute(subset(spark, sf)), "troute")


@query(
    "render_bmi_topmodel",
    _document(
        "topmodel",
        [
            _line("catchment", "catchment"),
            _line("divide_id", "catchment"),
            "'num_sub_catchments=1'",
            "'imap=1'",
            "'yes_print_output=1'",
            """'twi=[{''v'': ' || CAST(CAST(twi->0->'v' AS DOUBLE) AS VARCHAR) || ', ''frequency'': 0.25}, {''v'': ' ||
  CAST(CAST(twi->1->'v' AS DOUBLE) AS VARCHAR) || ', ''frequency'': 0.75}]'""",
            "'num_topodex_values=2'",
            "'area=1'",
            "'num_channels=1'",
            "'cum_dist_area_with_dist=1.0'",
            _line("dist_from_outlet", "round_even(lengthkm * 1000, 0)"),
            "'szm=0.0125'",
            "'t0=7.5e-05'",
            "'td=20'",
            "'chv=1000'",
            "'rv=1000'",
            "'srmax=0.04'",
            "'Q0=3.28e-05'",
            "'sr0=0'",
            "'infex=0'",
            "'xk0=2'",
            "'hf=0.1'",
            "'dth=0.1'",
        ],
        f"""SELECT a.basin, a.divide_id AS catchment, "dist_4.twi"::JSON AS twi, d.lengthkm FROM attrs a LEFT {_AREA}""",
    ),
)
def render_topmodel(spark, sf):
    return bmi.render_bmi_configs(params.params_topmodel(subset(spark, sf)), "topmodel")


_CFE_DOC = [
    "'forcing_file: BMI'",
    "'verbosity: 1'",
    "'surface_partitioning_scheme: Schaake'",
    "'surface_runoff_scheme: GIUH'",
    "'debug: 0'",
    "'num_timesteps: 1'",
    "'is_sft_coupled: 1'",
    "'ice_content_thresh: 0.15'",
    _line("soil_params.b", '"mode.bexp_soil_layers_stag=1"', sep=": "),
    _line("soil_params.satdk", '"geom_mean.dksat_soil_layers_stag=1"', "[m/s]", ": "),
    _line("soil_params.satpsi", '"geom_mean.psisat_soil_layers_stag=1"', "[m]", ": "),
    _line("soil_params.slop", '"mean.slope_1km"', "[m/m]", ": "),
    _line("soil_params.smcmax", "coalesce(\"mean.smcmax_soil_layers_stag=1\", 'nan')", "[m/m]", ": "),
    _line("soil_params.wltsmc", '"mean.smcwlt_soil_layers_stag=1"', "[m/m]", ": "),
    "'soil_params.expon: 1'",
    "'soil_params.expon_secondary: 1'",
    _line("max_gw_storage", '"mean.Zmax"', "[m]", ": "),
    _line("Cgw", '"mean.Coeff"', "[m/hr]", ": "),
    _line("expon", '"mode.Expon"', sep=": "),
    "'gw_storage: 0.05[m/m]'",
    "'alpha_fc: 0.33'",
    "'soil_storage: 0.5[m/m]'",
    "'K_nash: 0.003[1/m]'",
    "'K_lf: 0.01'",
    "'nash_storage: 0.0,0.0'",
    "'giuh_ordinates: 0.55,0.25,0.2'",
    "'a_Xinanjiang_inflection_point_parameter: NA'",
    "'b_Xinanjiang_shape_parameter: NA'",
    "'x_Xinanjiang_shape_parameter: NA'",
    "'urban_decimal_fraction: NA'",
    _line("refkdt", '"mean.refkdt"', sep=": "),
    "'soil_params.depth: 2[m]'",
]


@query(
    "render_bmi_cfe",
    _document("cfe", _CFE_DOC, "SELECT a.*, a.divide_id AS catchment FROM attrs a JOIN sac_params s ON s.divide_id = a.divide_id"),
)
def render_cfe(spark, sf):
    return bmi.render_bmi_configs(params.params_cfe(subset(spark, sf), calibrated(spark, sf), "CFE-S", True), "cfe")


# Documents with projected coordinates in full precision differ in the last digit between engines, so these are compared
# line by line, the numbers that depend on the catchment rounded and taken out of the text.
def _numbered(module: str, lines: list[tuple[str, str | None]], source: str) -> str:
    """Lines are given as SQL: the text without its number, and the number."""
    structs = ", ".join(f"{{'pos': {i}, 'text': {t}, 'number': round(({n or 'NULL'})::DOUBLE, 6)}}" for i, (t, n) in enumerate(lines))
    return (
        _SQL
        + f"""SELECT basin, catchment, file_name, l.pos AS pos, l.text AS text, l.number AS number
FROM (SELECT basin, catchment, catchment || '_bmi_config_{module}.txt' AS file_name, unnest([{structs}]) AS l FROM ({source}))"""
    )


def _text(line: str) -> tuple[str, None]:
    return "'" + line.replace("'", "''") + "'", None


def document_lines(documents, names: str):
    """(basin, catchment, file_name, pos, text, number): the lines of documents, rounded numbers apart for some names."""
    pattern = rf"^({names.replace(' ', '|')})(: |=)(-?[0-9][0-9.eE+-]*)"
    lines = documents.select("basin", "catchment", "file_name", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    number = F.round(F.nullif(F.regexp_extract("line", pattern, 3), F.lit("")).cast("double"), 6)
    return lines.select("basin", "catchment", "file_name", "pos", F.regexp_replace("line", pattern, "$1$2").alias("text"), number.alias("number"))


_PLACE = f"round({LAT_SQL}, 6)", f"round({LON_SQL}, 6)"
_PRESSURE = "round_even(101325 * pow(1 - 0.0065 * (6356766 * z / (6356766 + z)) / 288.15, 9.80665 / (0.0065 * 287.05287)), 4)"


@query(
    "render_bmi_snow17",
    _numbered(
        "snow17",
        [("'hru_id: ' || catchment", None), ("'hru_area: '", "hru_area"), ("'latitude: '", "latitude"), ("'elev: '", "elev"), _text("scf: 1.1"),
         ("'mf_max: '", "mf_max"), ("'mf_min: '", "mf_min"), ("'uadj: '", "uadj"),
         *map(_text, ["si: 500.0", "pxtemp: 1.0", "nmf: 0.15", "tipm: 0.1", "mbase: 0.0", "plwhc: 0.03", "daygm: 0.0", "adc1: 0.05"]),
         *[_text(f"adc{i}: {(i - 1) / 10}") for i in range(2, 12)]],
        _SNOW + f""", s.mfmax AS mf_max, s.mfmin AS mf_min, s.uadj AS uadj FROM attrs a
LEFT {_AREA} JOIN sac_params s ON s.divide_id = a.divide_id""",
    ),
)
def render_snow17(spark, sf):
    documents = bmi.render_bmi_configs(params.params_snow17(subset(spark, sf), calibrated(spark, sf)), "snow17")
    return document_lines(documents, "hru_area latitude elev mf_max mf_min uadj")


@query(
    "render_bmi_lstm",
    _numbered(
        "lstm",
        [("'area_sqkm: '", "areasqkm"), ("'basin_id: ' || basin", None), _text("basin_name: "), ("'elev_mean: '", "elev"), _text("inital_state: zero"),
         ("'lat: '", "lat"), ("'lon: '", "lon"), ("'slope_mean: '", "slope"), *map(_text, ["timestep: 1 hour", "train_cfg_file: ", "verbose: 0"])],
        f"""SELECT a.basin, a.divide_id AS catchment, d.areasqkm, "mean.elevation" * 0.01 AS elev, {_PLACE[0]} AS lat,
  {_PLACE[1]} AS lon, "mean.slope" AS slope FROM attrs a LEFT {_AREA}""",
    ),
)
def render_lstm(spark, sf):
    documents = bmi.render_bmi_configs(params.params_lstm(subset(spark, sf)), "lstm")
    return document_lines(documents, "area_sqkm elev_mean lat lon slope_mean")


@query(
    "render_bmi_lasam",
    _numbered(
        "lasam",
        [*map(_text, """verbosity=none
soil_params_file=vG_default_params.dat
layer_thickness=200.0[cm]
initial_psi=2000.0[cm]
timestep=300[sec]
endtime=1000[hr]
forcing_resolution=3600[sec]
ponded_depth_max=1.1[cm]
use_closed_form_G=False""".split("\n")),
         ("'layer_soil_type='", '"mode.ISLTYP"'),
         *map(_text, """max_soil_types=15
wilting_point_psi=15495.0[cm]
field_capacity_psi=340.9[cm]
giuh_ordinates=0.06,0.51,0.28,0.12,0.03
calib_params=True
adaptive_timestep=True
sft_coupled=False
soil_z=10,30,100.0,200.0[cm]""".split("\n"))],
        'SELECT basin, divide_id AS catchment, "mode.ISLTYP" FROM attrs',
    ),
)
def render_lasam(spark, sf):
    return document_lines(bmi.render_bmi_configs(params.params_lasam(subset(spark, sf), False), "lasam"), "layer_soil_type")


@query(
    "render_bmi_noahowp",
    _numbered(
        "noahowp",
        [*map(_text, """dt=3600.0 [s]
startdate=202408260000
enddate=202408260000
forcing_filename=.
output_filename=.
parameter_dir=test
general_table=GENPARM.TBL
soil_table=SOILPARM.TBL
noahowp_table=MPTABLE.TBL
soil_class_name=STAS
veg_class_name=USGS""".split("\n")),
         ("'lat= [degrees]'", "lat"), ("'lon= [degrees]'", "lon"), ("'terrain_slope= [degrees]'", '"mean.slope"'),
         ("'azimuth=  [degrees clockwise from north]'", '"circ_mean.aspect"'),
         *map(_text, """ZREF=10.0 [m]
rain_snow_thresh=0.5 [C]
precip_phase_option=6
snow_albedo_option=1
dynamic_veg_option=4
runoff_option=3
drainage_option=8
frozen_soil_option=1
dynamic_vic_option=1
radiative_transfer_option=3
sfc_drag_coeff_option=1
canopy_stom_resist_option=1
crop_model_option=0
snowsoil_temp_time_option=3
soil_temp_boundary_option=2
supercooled_water_option=1
stomatal_resistance_option=1
evap_srfc_resistance_option=4
subsurface_option=2""".split("\n")),
         ("'isltyp='", '"mode.ISLTYP"'), *map(_text, ["nsoil=4", "nsnow=3", "nveg=27"]), ("'vegtyp='", '"mode.IVGTYP"'), _text("croptype=0"),
         ("'sfctyp='", 'CASE WHEN "mode.IVGTYP" = 16 THEN 2 ELSE 1 END'),
         *map(_text, """soilcolor=4
dzsnso=0.0,0.0,0.0,0.1,0.3,0.6,1.0 [m]
sice=0.0,0.0,0.0,0.0 [m3/m3]
sh2o=0.3,0.3,0.3,0.3 [m3/m3]
zwt=-2.0 [m]""".split("\n"))],
        f'SELECT *, divide_id AS catchment, {_PLACE[0]} AS lat, {_PLACE[1]} AS lon FROM attrs',
    ),
)
def render_noahowp(spark, sf):
    documents = bmi.render_bmi_configs(params.params_noah_owp(subset(spark, sf)), "noahowp")
    return document_lines(documents, "lat lon terrain_slope azimuth isltyp vegtyp sfctyp")


@query(
    "render_bmi_ueb",
    _numbered(
        "ueb",
        [("'aspect: '", '"circ_mean.aspect"'), ("'slope: '", '"mean.slope"'), ("'longitude: '", "lon"), ("'latitude: '", "lat"), ("'elevation: '", "z"),
         ("'standard_atm_pressure: '", _PRESSURE),
         *map(_text, """jan_temp_range: 11.04395
feb_temp_range: 11.79382
mar_temp_range: 12.72711
apr_temp_range: 13.67701
may_temp_range: 13.70334
jun_temp_range: 13.76782
jul_temp_range: 13.90212
aug_temp_range: 13.9958
sep_temp_range: 14.04895
oct_temp_range: 13.44001
nov_temp_range: 11.90162
dec_temp_range: 10.71597""".split("\n"))],
        f'SELECT *, divide_id AS catchment, "mean.elevation" * 0.01 AS z, {_PLACE[0]} AS lat, {_PLACE[1]} AS lon FROM attrs',
    ),
)
def render_ueb(spark, sf):
    documents = bmi.render_bmi_configs(params.params_ueb(subset(spark, sf)), "ueb")
    return document_lines(documents, "aspect slope longitude latitude elevation standard_atm_pressure")


def defaults(spark, sf):
    """Nations as parameters, their region as module."""
    nation, region = (td.driver_table(spark, sf, t) for t in ("nation", "region"))
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("module"),
        F.col("n_nationkey").alias("pos"),
        F.col("n_name").alias("name"),
        (F.col("n_nationkey") / 4).cast("string").alias("default_value"),
        F.element_at(F.array(F.lit("True"), F.lit("FALSE"), F.lit("TRUE")), F.col("n_nationkey") % 3 + 1).alias("calibratable"),
    )


_DEFAULTS = """SELECT r_name AS module, n_nationkey AS pos, n_name AS name, CAST(n_nationkey / 4 AS VARCHAR) AS default_value,
  CASE n_nationkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'FALSE' ELSE 'TRUE' END AS calibratable
FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query(
    "render_default_configs",
    td.ctes("divides")
    + f""", docs AS (SELECT module, string_agg(name || '=' || default_value || chr(10), '' ORDER BY pos) AS content
  FROM ({_DEFAULTS}) GROUP BY module)
SELECT divide_id, module, divide_id || '_bmi_cfg_' || lower(module) || '.txt' AS file_name, content
FROM divides, docs WHERE module IN ('ASIA', 'EUROPE')""",
)
def render_default_configs(spark, sf):
    return bmi.render_default_configs(td.view(spark, sf, "divides"), defaults(spark, sf), ["ASIA", "EUROPE"])


@query("calibratable_parameters", f"SELECT module, name FROM ({_DEFAULTS}) WHERE upper(calibratable) = 'TRUE'")
def calibratable_parameters(spark, sf):
    return bmi.calibratable_parameters(defaults(spark, sf)).select("module", "name")


@query("read_param_defaults", f"SELECT module, name, default_value FROM ({_DEFAULTS})")
def read_param_defaults(spark, sf):
    root = new_path(spark, "defaults")
    written = defaults(spark, sf).select("module", "name", "default_value")
    written.coalesce(1).write.option("header", "true").partitionBy("module").csv(root)
    table = files.read_param_defaults(spark, root, "*.csv", r"module=([^/]+)/")
    return table.select("module", "name", "default_value")


@query(
    "read_layer",
    td.ctes("flowpaths") + " SELECT id, hydroseq FROM flowpaths WHERE vpuid IN ('01', '08') AND hydroseq > 100",
)
def read_layer(spark, sf):
    root = new_path(spark, "domains")
    sinks.write_vpu_partitioned(td.view(spark, sf, "flowpaths"), f"{root}/conus_hf/flowpaths")
    chosen = F.col("vpuid").isin("01", "08") & (F.col("hydroseq") > 100)
    return tables.read_layer(spark, root, "conus_hf", "flowpaths", chosen, ["id", "hydroseq"])


@query("read_contract", td.ctes("pois") + " SELECT poi_id, id, nex_id, vpuid FROM pois")
def read_contract(spark, sf):
    path = new_path(spark, "pois")
    td.view(spark, sf, "pois").withColumn("poi_id", F.col("poi_id").cast("bigint")).withColumn("extra", F.lit(1)).write.parquet(path)
    return tables.read_contract(spark, path, "pois")


@query("normalize_schema", "SELECT CAST(p_size AS BIGINT) AS p_size, p_partkey, p_name, p_retailprice FROM part")
def normalize_schema(spark, sf):
    part = td.driver_table(spark, sf, "part").select("p_size", "p_partkey", "p_name", "p_retailprice")
    return tables.normalize_schema(part)


@query("read_partitioned_collection", td.ctes("xs") + """ SELECT huc, flowpath_id, "TW" FROM xs""")
def read_partitioned_collection(spark, sf):
    root = new_path(spark, "collection")
    sections(spark, sf).select("huc", "flowpath_id", "TW").write.partitionBy("huc").parquet(root)
    found = tables.read_partitioned_collection(spark, root, r"huc=([^/]+)/", "huc")
    return found.select("huc", "flowpath_id", "TW")


_GPKG_SCHEMA = T.StructType(
    [
        T.StructField("divide_id", T.StringType()),
        T.StructField("areasqkm", T.DoubleType()),
        T.StructField("not_there", T.StringType()),
        T.StructField("geometry", T.BinaryType()),
    ]
)


def geopackages(spark, sf):
    """Divides as GeoPackage bytes, one package per batch of rows, some without the layer."""
    divides = td.view(spark, sf, "divides").select("divide_id", "areasqkm", "ds_id")

    def pack(batches):
        for number, batch in enumerate(batches):
            with sqlite3.connect(":memory:") as db:
                db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
                db.execute("INSERT INTO gpkg_geometry_columns VALUES ('divides', 'geom')")
                db.execute("CREATE TABLE divides (fid INTEGER PRIMARY KEY, divide_id TEXT, areasqkm REAL, geom BLOB)")
                header = b"GP" + bytes([0, 1]) + struct.pack("<i", 5070)
                for row in batch.itertuples():
                    point = struct.pack("<BIdd", 1, 1, row.ds_id, row.ds_id * 2)
                    values = (row.divide_id, row.areasqkm, header + point)
                    db.execute("INSERT INTO divides (divide_id, areasqkm, geom) VALUES (?, ?, ?)", values)
                    db.execute("INSERT INTO divides (divide_id, areasqkm, geom) VALUES (?, ?, ?)", values)
                db.commit()
                yield pd.DataFrame({"path": [f"{batch['divide_id'].iloc[0]}-{number}.gpkg"], "content": [db.serialize()]})

    return divides.mapInPandas(pack, "path string, content binary")


@query(
    "read_gpkg_layers",
    td.ctes("divides")
    + """ SELECT divide_id, areasqkm, CAST(NULL AS VARCHAR) AS not_there, '0101000000' AS wkb_head FROM divides""",
)
def read_gpkg_layers(spark, sf):
    rows = files.gpkg_rows(geopackages(spark, sf), "divides", _GPKG_SCHEMA).dropDuplicates(_GPKG_SCHEMA.names)
    return rows.select("divide_id", "areasqkm", "not_there", F.substring(F.hex("geometry"), 1, 10).alias("wkb_head"))


@query(
    "write_layers",
    td.ctes("flowpaths", "pois") + """ SELECT 'flowpaths' AS layer, count(*) AS n FROM flowpaths
UNION ALL SELECT 'pois', count(*) FROM pois""",
)
def write_layers(spark, sf):
    out = new_path(spark, "layers")
    pois = td.view(spark, sf, "pois")
    layers = {"flowpaths": td.view(spark, sf, "flowpaths"), "pois": pois, "empty": pois.where("poi_id < 0")}
    counts = None
    for name in sinks.write_layers(layers, out):
        n = spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return counts


@query("write_timeseries", "SELECT CAST(date_trunc('second', ts) AS VARCHAR) AS time, user_id, value FROM events")
def write_timeseries(spark, sf):
    out = new_path(spark, "series")
    rows = td.driver_table(spark, sf, "events").select("ts", "user_id", "value").withColumnRenamed("ts", "time")
    sinks.write_timeseries(rows, out, "csv", header=True)
    return spark.read.schema("time string, user_id bigint, value double").option("header", "true").csv(out)


@query("write_timeseries_parquet", "SELECT ts AS time, user_id, value FROM events")
def write_timeseries_parquet(spark, sf):
    out = new_path(spark, "series")
    rows = td.driver_table(spark, sf, "events").select("ts", "user_id", "value").withColumnRenamed("ts", "time")
    sinks.write_timeseries(rows, out, "parquet")
    return spark.read.parquet(out)


@query("write_vpu_partitioned", td.ctes("network") + " SELECT id, toid, vpuid FROM network")
def write_vpu_partitioned(spark, sf):
    out = new_path(spark, "by-vpu")
    sinks.write_vpu_partitioned(td.view(spark, sf, "network").select("id", "toid", "vpuid"), out)
    # Folder names are text here; they must not be read back as numbers.
    return spark.read.schema("id string, toid string, vpuid string").parquet(out)


@query("build_table_if_absent", td.ctes("pois") + " SELECT id, nex_id FROM pois")
def build_table_if_absent(spark, sf):
    out = new_path(spark, "once")
    pois = td.view(spark, sf, "pois").select("id", "nex_id")
    sinks.build_table_if_absent(pois, out)
    sinks.build_table_if_absent(pois.where("id = ''"), out)
    return spark.read.parquet(out)


@query("write_xs_by_huc", td.ctes("xs") + """ SELECT huc, flowpath_id, CAST(thalweg AS VARCHAR) AS thalweg FROM xs""")
def write_xs_by_huc(spark, sf):
    out = new_path(spark, "by-huc")
    sinks.write_xs_by_huc(sections(spark, sf).select("huc", "flowpath_id", "thalweg", "xs_max_elevation"), out)
    return spark.read.schema("flowpath_id string, thalweg string, huc string").parquet(out)


@query("write_xs_by_river", td.ctes("xs") + """ SELECT huc, river, flowpath_id, "TW" FROM xs""")
def write_xs_by_river(spark, sf):
    out = new_path(spark, "by-river")
    sinks.write_xs_by_river(sections(spark, sf).select("huc", "river", "flowpath_id", "TW"), out)
    return spark.read.schema("flowpath_id string, TW double, huc string, river string").parquet(out)


@query("replace_or_append", td.ctes("flowpaths", "nexus") + """ SELECT id, CAST(hydroseq AS INTEGER) AS hydroseq, CAST(NULL AS VARCHAR) AS type FROM flowpaths
UNION ALL SELECT id, NULL, type FROM nexus UNION ALL SELECT id, NULL, type FROM nexus""")
def replace_or_append(spark, sf):
    out = new_path(spark, "batches")
    flowpaths = td.view(spark, sf, "flowpaths").select("id", "hydroseq")
    nexus = td.view(spark, sf, "nexus").select("id", "type")
    sinks.replace_or_append([nexus], out, overwrite=True)
    sinks.replace_or_append([flowpaths, nexus], out, overwrite=True)
    sinks.replace_or_append([nexus], out, overwrite=False)
    return spark.read.schema("id string, hydroseq int, type string").parquet(out)


def orders_table(spark, sf):
    """Orders as a table with three snapshots: the first years, the rest appended, only open orders."""
    root = new_path(spark, "orders")
    orders = td.driver_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    base = versions.append_snapshot(orders.where(early), root, "first years")
    versions.tag_snapshot(spark, root, base, "base")
    versions.append_snapshot(orders.where(~early).withColumn("late", F.lit(True)), root, "later years")
    versions.overwrite_snapshot(orders.where(F.col("o_orderstatus") == "O"), root, "open only")
    return root


_EARLY = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < '1998-01-01'"


@query("as_of", _EARLY)
def as_of(spark, sf):
    return versions.as_of(spark, orders_table(spark, sf), 1).select("o_orderkey", "o_orderstatus")


@query("append_snapshot", "SELECT o_orderkey, CASE WHEN o_orderdate >= '1998-01-01' THEN true END AS late FROM orders")
def append_snapshot(spark, sf):
    return versions.as_of(spark, orders_table(spark, sf), 2).select("o_orderkey", "late")


@query("overwrite_snapshot", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def overwrite_snapshot(spark, sf):
    return versions.as_of(spark, orders_table(spark, sf)).select("o_orderkey")


@query("back_n", _EARLY)
def back_n(spark, sf):
    return versions.back_n(spark, orders_table(spark, sf), 2).select("o_orderkey", "o_orderstatus")


@query("tag", _EARLY)
def tag(spark, sf):
    return versions.as_of(spark, orders_table(spark, sf), tag="base").select("o_orderkey", "o_orderstatus")


@query(
    "history",
    """SELECT 3::BIGINT AS snapshot_id, 'overwrite' AS operation, 'open only' AS message
UNION ALL SELECT 2, 'append', 'later years' UNION ALL SELECT 1, 'append', 'first years'""",
)
def history(spark, sf):
    return versions.history(spark, orders_table(spark, sf)).select("snapshot_id", "operation", "message")


@query(
    "domain_history",
    """SELECT 'conus' AS domain, 'flowpaths' AS layer, 2::BIGINT AS snapshot_id, 'append' AS operation, 'again' AS message
UNION ALL SELECT 'conus', 'nexus', 1, 'append', 'built'""",
)
def domain_history(spark, sf):
    roots = {name: new_path(spark, name) for name in ("flowpaths", "nexus")}
    for name, root in roots.items():
        versions.append_snapshot(td.view(spark, sf, name).select("id"), root, "built")
    second = versions.append_snapshot(td.view(spark, sf, "flowpaths").select("id"), roots["flowpaths"], "again")
    one = spark.range(1)
    registry = one.select(
        F.lit("conus").alias("domain"), F.lit(second).cast("bigint").alias("flowpaths"), F.lit(1).cast("bigint").alias("nexus")
    )
    logs = {name: versions.table_log(spark, root) for name, root in roots.items()}
    return versions.domain_history(registry, logs, "conus_hf")


@query("upsert", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT -1 - c_custkey, 0 FROM customer WHERE c_acctbal < 0""")
def upsert(spark, sf):
    customer = td.driver_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    negative = customer.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0))
    new = negative.withColumn("c_custkey", -1 - F.col("c_custkey"))
    return versions.upsert(customer, negative.unionByName(new), "c_custkey")


@query("evolve", "SELECT p_partkey, p_size, CAST(NULL AS DOUBLE) AS length, p_size * 2 AS twice FROM part")
def evolve(spark, sf):
    part = td.driver_table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    return versions.evolve(part, {"length": F.lit(None).cast("double"), "twice": F.col("p_size") * 2}, ["p_name"])


@query("export_namespace", td.ctes("flowpaths", "pois") + """ SELECT 'flowpaths' AS layer, id, vpuid FROM flowpaths
UNION ALL SELECT 'pois', id, vpuid FROM pois""")
def export_namespace(spark, sf):
    source, target = new_path(spark, "source"), new_path(spark, "target")
    for name in ("flowpaths", "pois"):
        versions.append_snapshot(td.view(spark, sf, name), f"{source}/{name}")
    versions.export_namespace(spark, source, ["flowpaths", "pois"], target, "conus_hf")
    copies = [
        versions.as_of(spark, f"{target}/{name}").select(F.lit(name).alias("layer"), "id", "vpuid")
        for name in ("flowpaths", "pois")
    ]
    return copies[0].unionByName(copies[1])


@query("append_along_time", td.ctes("grid") + " SELECT x, y, value, year FROM grid")
def append_along_time(spark, sf):
    root = new_path(spark, "grid")
    grid = td.view(spark, sf, "grid").select("x", "y", "value", "year")
    versions.append_along_time(grid.where("year < 1998"), root)
    versions.append_along_time(grid.where("year >= 1998"), root)
    return versions.as_of(spark, root)


@query("null_violations", td.ctes("flowpaths") + """ SELECT f.field, 0::BIGINT AS nulls FROM (VALUES ('id'), ('toid'), ('divide_id'), ('vpuid')) f(field)""")
def null_violations(spark, sf):
    flowpaths = tables.as_contract(td.view(spark, sf, "flowpaths"), "flowpaths")
    assert flowpaths.columns == contract("flowpaths").names
    return tables.null_violations(flowpaths, "flowpaths")
