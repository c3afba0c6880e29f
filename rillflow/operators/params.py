"""Initial parameters of the hydrologic models, one row per catchment.

Every function takes the layers of a subset (see :mod:`rillflow.operators.subset`), with or without a ``basin``
column, and keeps that column. Rows stay columns to the end; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions.geo import albers_to_lonlat
from rillflow.functions.physics import (
    MEAN_SOIL_TEMPERATURE,
    cm_to_m,
    km_to_whole_m,
    standard_pressure,
    surface_type,
)
from rillflow.functions.text import python_float, quoted
from rillflow.plans.frames import by_shuffle

Subset = Mapping[str, DataFrame]

ATTRIBUTES = "divide-attributes"

# Domains whose calibrated parameter tables go by another name.
PARAMETER_DOMAINS = {"ak_hf": "Alaska", "hi_hf": "Hawaii", "prvi_hf": "Puerto_Rico", "conus_hf": "conus", "gl_hf": "gl"}


def parameter_table(module: str, domain: str) -> str:
    """Name of the calibrated table of a module in a domain."""
    return f"divide_parameters.{module}_{PARAMETER_DOMAINS[domain]}"


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("basin",) if c in df.columns] + ["divide_id"]


def prefix_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns whose name starts with a prefix."""
    return [c for c in df.columns if c.startswith(prefix)]


def column_or_zero(df: DataFrame, name: str) -> Column:
    """The column of exactly this name, or 0.0 if the table lacks it."""
    return quoted(name) if name in df.columns else F.lit(0.0)


def layer_mean(df: DataFrame, prefix: str) -> Column:
    """Mean of all columns with a prefix, row by row; missing values are left out, a table without any gives 0.0."""
    names = prefix_columns(df, prefix)
    if not names:
        return F.lit(0.0)
    total = sum((F.coalesce(quoted(n), F.lit(0.0)) for n in names[1:]), F.coalesce(quoted(names[0]), F.lit(0.0)))
    present = sum((quoted(n).isNotNull().cast("int") for n in names[1:]), quoted(names[0]).isNotNull().cast("int"))
    return F.when(present > 0, total / present)


def drop_and_rename(df: DataFrame, drop: list[str], rename: dict[str, str]) -> DataFrame:
    """Drop columns, then rename."""
    return df.drop(*drop).withColumnsRenamed(rename)


def left_equi(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on divide (and basin, where both have it)."""
    on = [k for k in _keys(left) if k in right.columns]
    return left.join(by_shuffle(right), on, "left")


def override_join(base: DataFrame, params: DataFrame, defaults: list[str]) -> DataFrame:
    """Replace default columns by calibrated ones; divides without calibrated values disappear."""
    kept = base.drop(*defaults)
    chosen = params.drop(*[c for c in params.columns if c in kept.columns and c != "divide_id"])
    return kept.join(by_shuffle(chosen), "divide_id")


def _constants(df: DataFrame, values: dict) -> DataFrame:
    def column(value) -> Column:
        if isinstance(value, list):
            return F.array(*[F.lit(v) for v in value])
        return value if isinstance(value, Column) else F.lit(value)

    return df.withColumns({name: column(value) for name, value in values.items()})


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keys and the attribute columns under their parameter names."""
    return df.select(*_keys(df), *[column_or_zero(df, source).alias(name) for name, source in names.items()])


def _areas(subset: Subset, *columns: str) -> DataFrame:
    divides = subset["divides"]
    return divides.select(*_keys(divides), *columns)


def _with_lonlat(df: DataFrame, x: str, y: str) -> DataFrame:
    lon, lat = albers_to_lonlat(F.col(x), F.col(y))
    return df.withColumns({"lon": lon, "lat": lat}).drop(x, y)


def _catchments(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("divide_id", "catchment")


def _soil_means(subset: Subset) -> DataFrame:
    attributes = subset[ATTRIBUTES]
    return attributes.select(
        *_keys(attributes),
        layer_mean(attributes, "mean.smcmax").alias("smcmax"),
        layer_mean(attributes, "mode.bexp").alias("b"),
        layer_mean(attributes, "geom_mean.psisat").alias("satpsi"),
    )


def params_sft(subset: Subset, use_schaake: bool = False) -> DataFrame:
    """Soil freeze-thaw."""
    return _catchments(
        _constants(
            _soil_means(subset),
            # Fixed values of the configuration file.
            {
                "verbosity": "none",
                "soil_moisture_bmi": 1,
                "end_time": "1.[d]",
                "dt": "1.0[h]",
                "quartz": 1.0,
                "ice_fraction_scheme": "Schaake" if use_schaake else "Xinanjiang",
                "soil_z": [0.1, 0.3, 1.0, 2.0],
                "soil_temperature": [MEAN_SOIL_TEMPERATURE] * 4,
            },
        )
    )


# Snow-17 defaults; the calibrated ones come first.
SNOW17_CALIBRATED = {"mfmax": 1.0, "mfmin": 0.2, "uadj": 0.05}

SNOW17_CONSTANTS = {
    "scf": 1.1,
    "si": 500.0,
    "pxtemp": 1.0,
    "nmf": 0.15,
    "tipm": 0.1,
    "mbase": 0.0,
    "plwhc": 0.03,
    "daygm": 0.0,
    **{f"adc{i}": v for i, v in enumerate([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], start=1)},
}


def params_snow17(subset: Subset, calibrated: DataFrame | None = None) -> DataFrame:
    """Snow-17; ``calibrated`` replaces the melt factors (for CONUS, unless the gauge is Canadian)."""
    names = {"elev": "mean.elevation", "x": "centroid_x", "y": "centroid_y"}
    base = left_equi(_named(subset[ATTRIBUTES], names), _areas(subset, "areasqkm"))
    base = _with_lonlat(base.withColumn("elev", cm_to_m(F.col("elev"))), "x", "y")
    base = _constants(base, SNOW17_CALIBRATED)
    if calibrated is not None:
        base = override_join(base, calibrated.select("divide_id", *SNOW17_CALIBRATED), list(SNOW17_CALIBRATED))
    renamed = drop_and_rename(
        base,
        ["lon"],
        {"areasqkm": "hru_area", "lat": "latitude", "mfmax": "mf_max", "mfmin": "mf_min"},
    )
    return _catchments(_constants(renamed, {**SNOW17_CONSTANTS, "hru_id": F.col("divide_id")}))


# Soil storage settings of the model that soil moisture profiles are coupled with.
SMP_COUPLED = {
    "CFE-S": {"soil_storage_model": "conceptual", "soil_storage_depth": "2.0"},
    "CFE-X": {"soil_storage_model": "conceptual", "soil_storage_depth": "2.0"},
    "TopModel": {"soil_storage_model": "TopModel", "water_table_based_method": "flux-based"},
    "LASAM": {
        "soil_storage_model": "layered",
        "soil_moisture_profile_option": "constant",
        "soil_depth_layers": "2.0",
        "water_table_depth": "10[m]",
    },
}

SMP_STORAGE = (
    "soil_storage_model",
    "soil_storage_depth",
    "water_table_based_method",
    "soil_moisture_profile_option",
    "soil_depth_layers",
    "water_table_depth",
)


def params_smp(subset: Subset, extra_module: str | None = None) -> DataFrame:
    """Soil moisture profiles, coupled with one of CFE-S, CFE-X, TopModel, LASAM or with none."""
    if extra_module and extra_module not in SMP_COUPLED:
        raise ValueError(f"soil moisture profiles cannot be coupled with {extra_module}; known are {', '.join(SMP_COUPLED)}")
    coupled = SMP_COUPLED.get(extra_module, {})
    return _catchments(
        _constants(
            _soil_means(subset),
            # Fixed values of the configuration file.
            {
                "verbosity": "none",
                "soil_z": [0.1, 0.3, 1.0, 2.0],
                "soil_moisture_fraction_depth": 0.4,
                **{name: coupled.get(name, "NA") for name in SMP_STORAGE},
            },
        )
    )


def params_lstm(subset: Subset, basin_id: str | None = None) -> DataFrame:
    """LSTM; the basin id is the identifier of the subset."""
    names = {"slope_mean": "mean.slope", "elev_mean": "mean.elevation", "x": "centroid_x", "y": "centroid_y"}
    base = left_equi(_named(subset[ATTRIBUTES], names), _areas(subset, "areasqkm"))
    base = _with_lonlat(base.withColumn("elev_mean", cm_to_m(F.col("elev_mean"))), "x", "y")
    return _catchments(
        _constants(
            base.withColumnRenamed("areasqkm", "area_sqkm"),
            # Fixed values of the configuration file.
            {
                "basin_id": _identifier(base, basin_id),
                "basin_name": "",
                "inital_state": "zero",
                "timestep": "1 hour",
                "train_cfg_file": "",
                "verbose": "0",
            },
        )
    )


def _identifier(df: DataFrame, given: str | None) -> Column:
    if given is not None:
        return F.lit(given)
    if "basin" not in df.columns:
        raise ValueError("give the identifier, as the subset has no basin column")
    return F.col("basin")


def params_lasam(subset: Subset, sft_included: bool, soil_params_file: str = "vG_default_params.dat") -> DataFrame:
    """LASAM; the soil type is an attribute, the rest constant."""
    return _catchments(
        _constants(
            _named(subset[ATTRIBUTES], {"layer_soil_type": "mode.ISLTYP"}),
            # Fixed values of the configuration file.
            {
                "verbosity": "none",
                "soil_params_file": soil_params_file,
                "layer_thickness": "200.0[cm]",
                "initial_psi": "2000.0[cm]",
                "timestep": "300[sec]",
                "endtime": "1000[hr]",
                "forcing_resolution": "3600[sec]",
                "ponded_depth_max": "1.1[cm]",
                "use_closed_form_G": False,
                "max_soil_types": 15,
                "wilting_point_psi": "15495.0[cm]",
                "field_capacity_psi": "340.9[cm]",
                "giuh_ordinates": [0.06, 0.51, 0.28, 0.12, 0.03],
                "calib_params": True,
                "adaptive_timestep": True,
                "sft_coupled": sft_included,
                "soil_z": [10.0, 30.0, 100.0, 200.0],
                "soil_z_text": "10,30,100.0,200.0",
            },
        )
    )


# Settings of the Noah-OWP-Modular configuration file, in its order.
NOAH_CONSTANTS = {
    "dt": 3600.0,
    "startdate": "202408260000",
    "enddate": "202408260000",
    "forcing_filename": ".",
    "output_filename": ".",
    "parameter_dir": "test",
    "general_table": "GENPARM.TBL",
    "soil_table": "SOILPARM.TBL",
    "noahowp_table": "MPTABLE.TBL",
    "soil_class_name": "STAS",
    "veg_class_name": "USGS",
    "ZREF": 10.0,
    "rain_snow_thresh": 0.5,
    "precip_phase_option": 6,
    "snow_albedo_option": 1,
    "dynamic_veg_option": 4,
    "runoff_option": 3,
    "drainage_option": 8,
    "frozen_soil_option": 1,
    "dynamic_vic_option": 1,
    "radiative_transfer_option": 3,
    "sfc_drag_coeff_option": 1,
    "canopy_stom_resist_option": 1,
    "crop_model_option": 0,
    "snowsoil_temp_time_option": 3,
    "soil_temp_boundary_option": 2,
    "supercooled_water_option": 1,
    "stomatal_resistance_option": 1,
    "evap_srfc_resistance_option": 4,
    "subsurface_option": 2,
    "nsoil": 4,
    "nsnow": 3,
    "nveg": 27,
    "croptype": 0,
    "soilcolor": 4,
    "dzsnso": [0.0, 0.0, 0.0, 0.1, 0.3, 0.6, 1.0],
    "sice": [0.0, 0.0, 0.0, 0.0],
    "sh2o": [0.3, 0.3, 0.3, 0.3],
    "zwt": -2.0,
}


def params_noah_owp(subset: Subset) -> DataFrame:
    """Noah-OWP-Modular."""
    names = {
        "terrain_slope": "mean.slope",
        "azimuth": "circ_mean.aspect",
        "x": "centroid_x",
        "y": "centroid_y",
        "isltyp": "mode.ISLTYP",
        "vegtyp": "mode.IVGTYP",
    }
    base = _with_lonlat(_named(subset[ATTRIBUTES], names), "x", "y")
    base = base.withColumn("vegtyp", F.col("vegtyp").cast("int")).withColumn("sfctyp", surface_type(F.col("vegtyp")))
    return _catchments(_constants(base, NOAH_CONSTANTS))


# Sacramento soil moisture defaults; the calibrated ones come first.
SACSMA_CALIBRATED = {
    "uztwm": 75.0,
    "uzfwm": 30.0,
    "lztwm": 150.0,
    "lzfpm": 300.0,
    "lzfsm": 150.0,
    "uzk": 0.3,
    "lzpk": 0.01,
    "lzsk": 0.1,
    "zperc": 100.0,
    "rexp": 2.0,
    "pfree": 0.1,
}
SACSMA_CONSTANTS = {"adimp": 0.0, "pctim": 0.0, "riva": 0.0, "side": 0.0, "rserv": 0.3}


def params_sacsma(subset: Subset, calibrated: DataFrame | None = None) -> DataFrame:
    """SAC-SMA; ``calibrated`` replaces eleven of the defaults (for CONUS, unless the gauge is Canadian)."""
    base = _constants(_areas(subset, "areasqkm"), {**SACSMA_CALIBRATED, **SACSMA_CONSTANTS})
    if calibrated is not None:
        base = override_join(base, calibrated.select("divide_id", *SACSMA_CALIBRATED), list(SACSMA_CALIBRATED))
    return _catchments(base.withColumnRenamed("areasqkm", "hru_area").withColumn("hru_id", F.col("divide_id")))


# Constant sections of the T-Route configuration.
TROUTE_BMI = {
    "flowpath_columns": ["id", "toid", "lengthkm"],
    "attributes_columns": [
        "attributes_id",
        "rl_gages",
        "rl_NHDWaterbodyComID",
        "MusK",
        "MusX",
        "n",
        "So",
        "ChSlp",
        "BtmWdth",
        "nCC",
        "TopWdthCC",
        "TopWdth",
    ],
    "waterbody_columns": [
        "hl_link",
        "ifd",
        "LkArea",
        "LkMxE",
        "OrificeA",
        "OrificeC",
        "OrificeE",
        "WeirC",
        "WeirE",
        "WeirL",
    ],
    "network_columns": ["network_id", "hydroseq", "hl_uri"],
}
TROUTE_LOG = {"showtiming": True, "log_level": "DEBUG"}
TROUTE_COMPUTE = {
    "parallel_compute_method": "by-subnetwork-jit-clustered",
    "subnetwork_target_size": 10000,
    "cpu_pool": 16,
    "compute_kernel": "V02-structured",
    "assume_short_ts": True,
    "restart_parameters": {"start_datetime": ""},
    "forcing_parameters": {
        "qts_subdivisions": 12,
        "dt": 300,
        "qlat_input_folder": ".",
        "qlat_file_pattern_filter": "nex-*",
        "nts": 5,
        "max_loop_size": 1,
    },
    "data_assimilation_parameters": {
        "usgs_timeslices_folder": None,
        "usace_timeslices_folder": None,
        "timeslice_lookback_hours": 48,
        "qc_threshold": 1,
        "streamflow_da": {
            "streamflow_nudging": False,
            "diffusive_streamflow_nudging": False,
            "gage_segID_crosswalk_file": None,
        },
        "reservoir_da": {
            "reservoir_persistence_da": {
                "reservoir_persistence_usgs": False,
                "reservoir_persistence_usace": False,
            },
            "reservoir_rfc_da": {
                "reservoir_rfc_forecasts": False,
                "reservoir_rfc_forecasts_time_series_path": None,
                "reservoir_rfc_forecasts_lookback_hours": 28,
                "reservoir_rfc_forecasts_offset_hours": 28,
                "reservoir_rfc_forecast_persist_days": 11,
            },
            "reservoir_parameter_file": None,
        },
    },
}
TROUTE_OUTPUT = {
    "stream_output": {
        "stream_output_directory": ".",
        "stream_output_time": 1,
        "stream_output_type": ".nc",
        "stream_output_internal_frequency": 60,
    }
}
TROUTE_NETWORK_COLUMNS = {
    "key": "id",
    "downstream": "toid",
    "dx": "lengthkm",
    "n": "n",
    "ncc": "nCC",
    "s0": "So",
    "bw": "BtmWdth",
    "waterbody": "rl_NHDWaterbodyComID",
    "gages": "rl_gages",
    "tw": "TopWdth",
    "twcc": "TopWdthCC",
    "musk": "MusK",
    "musx": "MusX",
    "cs": "ChSlp",
    "alt": "alt",
}
# Segments that the routing network lists twice.
TROUTE_DUPLICATE_SEGMENTS = [
    "717696",
    "1311881",
    "3133581",
    "1010832",
    "1023120",
    "1813525",
    "1531545",
    "1304859",
    "1320604",
    "1233435",
    "11816",
    "1312051",
    "2723765",
    "2613174",
    "846266",
    "1304891",
    "1233595",
    "1996602",
    "2822462",
    "2384576",
    "1021504",
    "2360642",
    "1326659",
    "1826754",
    "572364",
    "1336910",
    "1332558",
    "1023054",
    "3133527",
    "3053788",
    "3101661",
    "2043487",
    "3056866",
    "1296744",
    "1233515",
    "2045165",
    "1230577",
    "1010164",
    "1031669",
    "1291638",
    "1637751",
]


def params_troute(subset: Subset, identifier: str | None = None) -> DataFrame:
    """T-Route: constant sections, and the network section naming the gauge's geopackage."""
    attributes = subset[ATTRIBUTES]
    base = attributes.select(*_keys(attributes))
    file = F.concat(F.lit("'gauge_"), _identifier(base, identifier), F.lit(".gpkg'"))
    network = F.concat(
        F.lit("{'supernetwork_parameters': {'geo_file_path': "),
        file,
        F.lit("}, 'waterbody_parameters': {'level_pool': {'level_pool_waterbody_parameter_file_path': "),
        file,
        F.lit("}}}"),
    )
    return _catchments(
        _constants(
            base,
            {
                "bmi_param": str(TROUTE_BMI),
                "log_param": str(TROUTE_LOG),
                "nwtopo_param": network,
                "comp_param": str(TROUTE_COMPUTE),
                "output_param": str(TROUTE_OUTPUT),
                "ntwk_columns": str(TROUTE_NETWORK_COLUMNS),
                "res_da": str(TROUTE_COMPUTE["data_assimilation_parameters"]["reservoir_da"]),
                "stream_da": str(TROUTE_COMPUTE["data_assimilation_parameters"]["streamflow_da"]),
                "dupseg": TROUTE_DUPLICATE_SEGMENTS,
            },
        )
    )


TWI_TYPE = "array<struct<v:double,frequency:double>>"


def twi_bins(text: Column) -> Column:
    """Topographic wetness distribution, from its JSON text."""
    return F.from_json(text, TWI_TYPE)


def params_topmodel(subset: Subset) -> DataFrame:
    """TOPMODEL: wetness bins and the flowpath length in whole metres."""
    base = left_equi(_named(subset[ATTRIBUTES], {"twi_text": "dist_4.twi"}), _areas(subset, "lengthkm"))
    bins = twi_bins(F.col("twi_text"))
    entry = F.transform(
        bins,
        lambda b: F.concat(
            F.lit("{'v': "), python_float(b["v"]), F.lit(", 'frequency': "), python_float(b["frequency"]), F.lit("}")
        ),
    )
    base = base.withColumns(
        {
            "twi": bins,
            "twi_list": F.concat(F.lit("["), F.array_join(entry, ", "), F.lit("]")),
            "num_topodex_values": F.size(bins),
            "dist_from_outlet": km_to_whole_m(F.col("lengthkm")),
        }
    ).drop("twi_text", "lengthkm")
    return _catchments(
        _constants(
            base.withColumn("divide", F.col("divide_id")),
            {
                "num_sub_catchments": 1,
                "imap": 1,
                "yes_print_output": 1,
                "area": 1,
                "num_channels": 1,
                "cum_dist_area_with_dist": 1.0,
                "szm": 0.0125,
                "t0": 0.000075,
                "td": 20,
                "chv": 1000,
                "rv": 1000,
                "srmax": 0.04,
                "Q0": 0.0000328,
                "sr0": 0,
                "infex": 0,
                "xk0": 2,
                "hf": 0.1,
                "dth": 0.1,
            },
        )
    )


# Mean daily temperature range by month.
UEB_RANGES = {
    "jan": 11.04395,
    "feb": 11.79382,
    "mar": 12.72711,
    "apr": 13.67701,
    "may": 13.70334,
    "jun": 13.76782,
    "jul": 13.90212,
    "aug": 13.9958,
    "sep": 14.04895,
    "oct": 13.44001,
    "nov": 11.90162,
    "dec": 10.71597,
}


def params_ueb(subset: Subset, calibrated: DataFrame | None = None) -> DataFrame:
    """Utah energy balance; ``calibrated`` holds twelve monthly ranges b01..b12 (for CONUS, unless Canadian)."""
    names = {
        "slope": "mean.slope",
        "aspect": "circ_mean.aspect",
        "elevation": "mean.elevation",
        "x": "centroid_x",
        "y": "centroid_y",
    }
    base = _named(subset[ATTRIBUTES], names).withColumn("elevation", cm_to_m(F.col("elevation")))
    base = drop_and_rename(_with_lonlat(base, "x", "y"), [], {"lon": "longitude", "lat": "latitude"})
    defaults = {f"{month}_temp_range": value for month, value in UEB_RANGES.items()}
    base = _constants(base, defaults)
    if calibrated is not None:
        months = {f"b{i:02d}": name for i, name in enumerate(defaults, start=1)}
        base = override_join(base, drop_and_rename(calibrated.select("divide_id", *months), [], months), list(defaults))
    return _catchments(base.withColumn("standard_atm_pressure", standard_pressure(F.col("elevation"))))


# Constants of the conceptual functional equivalent model.
CFE_CONSTANTS = {
    "forcing_file": "BMI",
    "verbosity": "1",
    "surface_runoff_scheme": "GIUH",
    "debug": "0",
    "num_timesteps": "1",
    "ice_content_thresh": "0.15",
    "soil_params_expon": "1",
    "soil_params_expon_secondary": "1",
    "gw_storage": "0.05",
    "alpha_fc": "0.33",
    "soil_storage": "0.5",
    "K_nash": "0.003",
    "K_lf": "0.01",
    "nash_storage": [0.0, 0.0],
    "giuh_ordinates": [0.55, 0.25, 0.2],
    "soil_params_depth": "2",
}
CFE_ATTRIBUTES = {
    "soil_params_b": "mode.bexp_soil_layers_stag=1",
    "soil_params_satdk": "geom_mean.dksat_soil_layers_stag=1",
    "soil_params_satpsi": "geom_mean.psisat_soil_layers_stag=1",
    "soil_params_slop": "mean.slope_1km",
    "soil_params_smcmax": "mean.smcmax_soil_layers_stag=1",
    "soil_params_wltsmc": "mean.smcwlt_soil_layers_stag=1",
    "max_gw_storage": "mean.Zmax",
    "Cgw": "mean.Coeff",
    "expon": "mode.Expon",
    "refkdt": "mean.refkdt",
}
XINANJIANG = (
    "a_Xinanjiang_inflection_point_parameter",
    "b_Xinanjiang_shape_parameter",
    "x_Xinanjiang_shape_parameter",
)


def params_cfe(subset: Subset, calibrated: DataFrame, version: str, sft_included: bool = False) -> DataFrame:
    """CFE in its Xinanjiang (CFE-X) or Schaake (CFE-S) version, for the divides with calibrated parameters."""
    if version not in ("CFE-X", "CFE-S"):
        raise ValueError(f"CFE has the versions CFE-X and CFE-S, not {version}")
    attributes = subset[ATTRIBUTES]
    missing = [c for c in CFE_ATTRIBUTES.values() if c not in attributes.columns]
    if missing:
        raise ValueError(f"divide attributes lack {', '.join(missing)}")
    base = _named(attributes, CFE_ATTRIBUTES).join(by_shuffle(calibrated.select("divide_id", *XINANJIANG)), "divide_id")
    if version == "CFE-X":
        scheme = {
            "surface_partitioning_scheme": "Xinanjiang",
            "is_sft_coupled": "NA",
            "urban_decimal_fraction": "0.01",
            **{name: python_float(F.col(name)) for name in XINANJIANG},
        }
    else:
        scheme = {
            "surface_partitioning_scheme": "Schaake",
            "is_sft_coupled": "1" if sft_included else "0",
            "urban_decimal_fraction": "NA",
            **{name: "NA" for name in XINANJIANG},
        }
    return _catchments(_constants(base, {**scheme, **CFE_CONSTANTS}))
