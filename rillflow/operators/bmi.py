"""Model configuration documents: one text per catchment, built inside Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.functions.sections import let
from rillflow.functions.text import python_float


# The lines of each configuration file, with the parameter columns in braces.
TEMPLATES = {
    "sft": """verbosity={verbosity}
soil_moisture_bmi={soil_moisture_bmi}
end_time={end_time}
dt={dt}
soil_params.smcmax={smcmax}
soil_params.b={b}
soil_params.satpsi={satpsi}
soil_params.quartz={quartz}
ice_fraction_scheme={ice_fraction_scheme}
soil_z={soil_z}[m]
soil_temperature={soil_temperature}[K]""",
    "snow17": """hru_id: {hru_id}
hru_area: {hru_area}
latitude: {latitude}
elev: {elev}
scf: {scf}
mf_max: {mf_max}
mf_min: {mf_min}
uadj: {uadj}
si: {si}
pxtemp: {pxtemp}
nmf: {nmf}
tipm: {tipm}
mbase: {mbase}
plwhc: {plwhc}
daygm: {daygm}
adc1: {adc1}
adc2: {adc2}
adc3: {adc3}
adc4: {adc4}
adc5: {adc5}
adc6: {adc6}
adc7: {adc7}
adc8: {adc8}
adc9: {adc9}
adc10: {adc10}
adc11: {adc11}""",
    "smp": """verbosity={verbosity}
soil_params.smcmax={smcmax}
soil_params.b={b}
soil_params.satpsi={satpsi}
soil_z={soil_z}[m]
soil_moisture_fraction_depth={soil_moisture_fraction_depth}[m]""",
    "sacsma": """hru_id: {hru_id}
hru_area: {hru_area}
uztwm: {uztwm}
uzfwm: {uzfwm}
lztwm: {lztwm}
lzfpm: {lzfpm}
lzfsm: {lzfsm}
adimp: {adimp}
uzk: {uzk}
lzpk: {lzpk}
lzsk: {lzsk}
zperc: {zperc}
rexp: {rexp}
pctim: {pctim}
pfree: {pfree}
riva: {riva}
side: {side}
rserv: {rserv}""",
    "lstm": """area_sqkm: {area_sqkm}
basin_id: {basin_id}
basin_name: {basin_name}
elev_mean: {elev_mean}
inital_state: {inital_state}
lat: {lat}
lon: {lon}
slope_mean: {slope_mean}
timestep: {timestep}
train_cfg_file: {train_cfg_file}
verbose: {verbose}""",
    "lasam": """verbosity={verbosity}
soil_params_file={soil_params_file}
layer_thickness={layer_thickness}
initial_psi={initial_psi}
timestep={timestep}
endtime={endtime}
forcing_resolution={forcing_resolution}
ponded_depth_max={ponded_depth_max}
use_closed_form_G={use_closed_form_G}
layer_soil_type={layer_soil_type}
max_soil_types={max_soil_types}
wilting_point_psi={wilting_point_psi}
field_capacity_psi={field_capacity_psi}
giuh_ordinates={giuh_ordinates}
calib_params={calib_params}
adaptive_timestep={adaptive_timestep}
sft_coupled={sft_coupled}
soil_z={soil_z_text}[cm]""",
    "noahowp": """dt={dt} [s]
startdate={startdate}
enddate={enddate}
forcing_filename={forcing_filename}
output_filename={output_filename}
parameter_dir={parameter_dir}
general_table={general_table}
soil_table={soil_table}
noahowp_table={noahowp_table}
soil_class_name={soil_class_name}
veg_class_name={veg_class_name}
lat={lat} [degrees]
lon={lon} [degrees]
terrain_slope={terrain_slope} [degrees]
azimuth={azimuth}  [degrees clockwise from north]
ZREF={ZREF} [m]
rain_snow_thresh={rain_snow_thresh} [C]
precip_phase_option={precip_phase_option}
snow_albedo_option={snow_albedo_option}
dynamic_veg_option={dynamic_veg_option}
runoff_option={runoff_option}
drainage_option={drainage_option}
frozen_soil_option={frozen_soil_option}
dynamic_vic_option={dynamic_vic_option}
radiative_transfer_option={radiative_transfer_option}
sfc_drag_coeff_option={sfc_drag_coeff_option}
canopy_stom_resist_option={canopy_stom_resist_option}
crop_model_option={crop_model_option}
snowsoil_temp_time_option={snowsoil_temp_time_option}
soil_temp_boundary_option={soil_temp_boundary_option}
supercooled_water_option={supercooled_water_option}
stomatal_resistance_option={stomatal_resistance_option}
evap_srfc_resistance_option={evap_srfc_resistance_option}
subsurface_option={subsurface_option}
isltyp={isltyp}
nsoil={nsoil}
nsnow={nsnow}
nveg={nveg}
vegtyp={vegtyp}
croptype={croptype}
sfctyp={sfctyp}
soilcolor={soilcolor}
dzsnso={dzsnso} [m]
sice={sice} [m3/m3]
sh2o={sh2o} [m3/m3]
zwt={zwt} [m]""",
    "troute": """bmi_parameters: {bmi_param}
log_parameters: {log_param}
network_topology_parameters: {nwtopo_param}
compute_parameters: {comp_param}
output_param: {output_param}""",
    "topmodel": """catchment={catchment}
divide_id={divide}
num_sub_catchments={num_sub_catchments}
imap={imap}
yes_print_output={yes_print_output}
twi={twi_list}
num_topodex_values={num_topodex_values}
area={area}
num_channels={num_channels}
cum_dist_area_with_dist={cum_dist_area_with_dist}
dist_from_outlet={dist_from_outlet}
szm={szm}
t0={t0}
td={td}
chv={chv}
rv={rv}
srmax={srmax}
Q0={Q0}
sr0={sr0}
infex={infex}
xk0={xk0}
hf={hf}
dth={dth}""",
    "ueb": """aspect: {aspect}
slope: {slope}
longitude: {longitude}
latitude: {latitude}
elevation: {elevation}
standard_atm_pressure: {standard_atm_pressure}
jan_temp_range: {jan_temp_range}
feb_temp_range: {feb_temp_range}
mar_temp_range: {mar_temp_range}
apr_temp_range: {apr_temp_range}
may_temp_range: {may_temp_range}
jun_temp_range: {jun_temp_range}
jul_temp_range: {jul_temp_range}
aug_temp_range: {aug_temp_range}
sep_temp_range: {sep_temp_range}
oct_temp_range: {oct_temp_range}
nov_temp_range: {nov_temp_range}
dec_temp_range: {dec_temp_range}""",
    "cfe": """forcing_file: {forcing_file}
verbosity: {verbosity}
surface_partitioning_scheme: {surface_partitioning_scheme}
surface_runoff_scheme: {surface_runoff_scheme}
debug: {debug}
num_timesteps: {num_timesteps}
is_sft_coupled: {is_sft_coupled}
ice_content_thresh: {ice_content_thresh}
soil_params.b: {soil_params_b}
soil_params.satdk: {soil_params_satdk}[m/s]
soil_params.satpsi: {soil_params_satpsi}[m]
soil_params.slop: {soil_params_slop}[m/m]
soil_params.smcmax: {soil_params_smcmax}[m/m]
soil_params.wltsmc: {soil_params_wltsmc}[m/m]
soil_params.expon: {soil_params_expon}
soil_params.expon_secondary: {soil_params_expon_secondary}
max_gw_storage: {max_gw_storage}[m]
Cgw: {Cgw}[m/hr]
expon: {expon}
gw_storage: {gw_storage}[m/m]
alpha_fc: {alpha_fc}
soil_storage: {soil_storage}[m/m]
K_nash: {K_nash}[1/m]
K_lf: {K_lf}
nash_storage: {nash_storage}
giuh_ordinates: {giuh_ordinates}
a_Xinanjiang_inflection_point_parameter: {a_Xinanjiang_inflection_point_parameter}
b_Xinanjiang_shape_parameter: {b_Xinanjiang_shape_parameter}
x_Xinanjiang_shape_parameter: {x_Xinanjiang_shape_parameter}
urban_decimal_fraction: {urban_decimal_fraction}
refkdt: {refkdt}
soil_params.depth: {soil_params_depth}[m]""",
}


def _as_text(df: DataFrame, name: str) -> Column:
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.DoubleType):
        return F.array_join(F.transform(column, python_float), ",")
    return F.coalesce(column.cast("string"), F.lit("None"))


def render_bmi_configs(params: DataFrame, module: str) -> DataFrame:
    """``([basin,] catchment, module, file_name, content)`` from the parameter rows of a module."""
    if module not in TEMPLATES:
        raise ValueError(f"no configuration format for module {module!r}")
    pieces = re.split(r"\{(\w+)\}", TEMPLATES[module])
    numbers = [n for n in dict.fromkeys(pieces[1::2]) if isinstance(params.schema[n].dataType, T.DoubleType)]

    def content(texts: Column) -> Column:
        """The lines, with the numbers' texts given as an array."""
        filled = {n: F.get(texts, F.lit(i)) for i, n in enumerate(numbers)}
        named = [filled[p] if p in filled else _as_text(params, p) for p in pieces[1::2]]
        fixed = [F.lit(p) for p in pieces[::2]]
        return F.concat(*[part for pair in zip(fixed, [*named, F.lit("")], strict=True) for part in pair])

    # All numbers of a document are formatted by one expression, evaluated once per row.
    texts = F.transform(F.array(*[F.col(n) for n in numbers]), python_float)
    document = let(texts, content) if numbers else content(F.array())
    keys = [c for c in ("basin",) if c in params.columns]
    return params.select(
        *keys,
        "catchment",
        F.lit(module).alias("module"),
        F.concat("catchment", F.lit(f"_bmi_config_{module}.txt")).alias("file_name"),
        document.alias("content"),
    )


def default_documents(defaults: DataFrame) -> DataFrame:
    """``(module, content)``: the ``name=value`` lines of each module's default table in row order.

    A default table describes one model and has a few dozen rows.
    """
    line = F.concat(F.col("name"), F.lit("="), F.coalesce("default_value", F.lit("nan")), F.lit("\n"))
    listed = defaults.groupBy("module").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return listed.select("module", F.array_join(F.col("l.line"), "").alias("content"))


def render_default_configs(divides: DataFrame, defaults: DataFrame, modules: list[str]) -> DataFrame:
    """Every divide's default document of each module, and its file name.

    Each module's text is built once and joined on the module, so the divides are not paired with single parameters.
    """
    wanted = divides.select("divide_id", F.explode(F.array(*[F.lit(m) for m in modules])).alias("module"))
    named = F.concat("divide_id", F.lit("_bmi_cfg_"), F.lower("module"), F.lit(".txt"))
    documents = default_documents(defaults.where(F.col("module").isin(modules)))
    return wanted.join(documents, "module").select("divide_id", "module", named.alias("file_name"), "content")


def calibratable_parameters(defaults: DataFrame) -> DataFrame:
    """Parameters that may be calibrated; the flag is spelled in several ways."""
    return defaults.where(F.upper(F.trim("calibratable")) == "TRUE")
