import datetime as dt
import math
import random
import struct

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rillflow.functions import geo
from rillflow.operators import bmi, conflation, params, series, versions, xs, zonal
from rillflow.plans.ranking import _spread, ntile_of, row_index, with_rank

DAY = dt.timedelta(days=1)


def test_rank_is_exact_when_one_group_holds_most_rows(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{i % 7}" if i % 7 else None, rng.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = with_rank(df, ["g"], ["v", "i"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    frame = pd.DataFrame(rows, columns=["g", "v", "i"]).sort_values(["g", "v", "i"])
    groups = frame.groupby("g", dropna=False)
    frame["rank"], frame["n"] = groups.cumcount() + 1, groups["i"].transform("count")
    expected = {(r.g if isinstance(r.g, str) else None, r.i): (r.rank, r.n) for r in frame.itertuples()}
    assert {(r.g, r.i): (r["rank"], r.group_rows) for r in ranked} == expected


def test_equal_values_are_ranked_in_several_tasks(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in _spread(rows, ["g"], ["v"]).groupBy(F.spark_partition_id()).count().collect()]
        ranked = with_rank(rows, ["g"], ["v"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < 2 * 20_000 / len(sizes)
    assert sorted(r["rank"] for r in ranked) == list(range(1, 20_001)) and {r.group_rows for r in ranked} == {20_000}
    by_rank = [r.v for r in sorted(ranked, key=lambda r: r["rank"])]
    assert by_rank == sorted(by_rank)


def test_row_index_counts_from_one(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("v")).repartition(5)
    assert [(r.v, r.n) for r in row_index(df, ["v"], "n").orderBy("n").limit(2).collect()] == [(0, 1), (1, 2)]


@pytest.mark.parametrize("rows", [1, 3, 4, 10, 11])
def test_ntile_equals_sql(spark, rows):
    df = spark.range(1, rows + 1).select(F.col("id").alias("r"))
    ours = [x[0] for x in df.select(ntile_of(F.col("r"), F.lit(rows), 4)).orderBy("r").collect()]
    sql = [x[0] for x in df.selectExpr("ntile(4) over (order by r) as t").orderBy("t").collect()]
    assert ours == sql


def nearest(observed, step=dt.timedelta(minutes=15)):
    times = sorted(observed)
    at = dt.datetime.combine(times[0].date(), dt.time())
    end = dt.datetime.combine(times[-1].date(), dt.time()) + DAY
    out = []
    while at < end:
        best = min(times, key=lambda t: (abs(t - at), -t.timestamp()))
        out.append((at, observed[best]))
        at += step
    return out


@pytest.mark.parametrize(
    "offsets",
    [[0.0, 1.0], [0.0, 1.0, 5.0], [0.5], [0.25, 1.5, 2.01, 40.3], [30.0, 31.0, 62.5]],
)
def test_daily_values_on_a_15_minute_grid(spark, offsets):
    start = dt.datetime(2023, 4, 1)
    observed = {start + dt.timedelta(days=o): float(i) for i, o in enumerate(offsets)}
    rows = [("s", t, v, "daily") for t, v in observed.items()]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, result double, timestep string")
    got = [(r.time, r.result) for r in series.upsample_daily_nearest(df).orderBy("time").collect()]
    assert got == nearest(observed)


def test_two_days_have_192_slices_and_ties_go_to_the_later_day(spark):
    rows = [("s", dt.datetime(2023, 4, d), float(d)) for d in (1, 2)]
    df = spark.createDataFrame(rows, "id string, time timestamp_ntz, result double")
    got = {r.time: r.result for r in series.upsample_daily_nearest(df).collect()}
    assert len(got) == 192
    assert got[dt.datetime(2023, 4, 1, 11, 45)] == 1.0 and got[dt.datetime(2023, 4, 1, 12)] == 2.0


def test_series_that_are_not_daily_fail(spark):
    df = spark.createDataFrame([("s", dt.datetime(2023, 4, 1), 1.0, "hourly")], "id string, time timestamp_ntz, result double, timestep string")
    with pytest.raises(Exception, match="only daily series"):
        series.upsample_daily_nearest(df).collect()


def test_range_includes_both_ends_and_skips_missing_flow(spark):
    start = dt.datetime(2021, 12, 31, 14)
    rows = [("01010000", start + dt.timedelta(hours=h), None if h == 30 else float(h), None) for h in range(-5, 40)]
    flow = spark.createDataFrame(rows, "id string, time timestamp_ntz, q_cms double, q_cms_denoted_3 double")
    got = series.streamflow_request(flow, "01010000", start, start + DAY)
    assert got.columns == ["time", "q_cms"] and got.count() == 25
    with pytest.raises(series.NoResults):
        series.streamflow_request(flow, "nope", start, start + DAY)


def test_release_item_must_be_single(spark):
    columns = "parameterGroup string, parameterName string, parameterUnit string, id int"
    good = (*series.RELEASE_ITEM.values(), 1)
    other = ("Lake/Reservoir Outflow", "Lake/Reservoir Release - Total", "m3", 2)
    assert series.single_release_item(spark.createDataFrame([good, other], columns)).id == 1
    with pytest.raises(ValueError, match="no total release"):
        series.single_release_item(spark.createDataFrame([other], columns))
    with pytest.raises(ValueError, match="several total releases"):
        series.single_release_item(spark.createDataFrame([good, good], columns))


def test_box_must_have_an_area(spark):
    df = spark.createDataFrame([("1", 0.0, 0.0, 1.0, 1.0)], "flowpath_id string, min_x double, min_y double, max_x double, max_y double")
    assert xs.subset_xs(df, bbox=(0, 0, 1, 1)).count() == 1
    with pytest.raises(ValueError, match="exceed"):
        xs.subset_xs(df, bbox=(1, 0, 1, 1))
    with pytest.raises(ValueError, match="identifier or a bounding box"):
        xs.subset_xs(df)


def test_flat_or_short_transects_are_no_channel(spark):
    points = "array<struct<x:double,Y:double>>"
    rows = [
        (1, [(0.0, 1.0), (1.0, 0.0), (2.0, 1.0)], [0.0, 2.0]),
        (2, [(0.0, 1.0), (1.0, 0.9), (2.0, 1.0)], [0.0, 2.0]),
        (3, [(0.0, 1.0), (1.0, 0.0), (2.0, 1.0)], [0.0, 1.0]),
        (4, [(0.0, 3.0), (0.0, 0.0), (2.0, 0.0), (2.0, 3.0)], [0.0, 2.0]),
    ]
    got = {r.k: r for r in xs.channel_metrics(spark.createDataFrame(rows, f"k int, points {points}, banks array<double>")).collect()}
    assert set(got) == {1, 4}
    assert (got[1].Ym, got[1].TW, got[1].A, got[1].r) == (1.0, 2.0, 1.0, 1.0)
    assert got[4].r == float("inf")


def lambert_forward(lon, lat, zone):
    """Conic coordinates in metres, by the textbook's forward formulas."""
    n, scale, origin = zone.cone()
    e, sine = math.sqrt(0.00669438002290), math.sin(math.radians(lat))
    t = math.tan(math.pi / 4 - math.radians(lat) / 2) / ((1 - e * sine) / (1 + e * sine)) ** (e / 2)
    theta = n * math.radians(lon - zone.lon)
    return zone.east + scale * t**n * math.sin(theta), zone.north + origin - scale * t**n * math.cos(theta)


def test_sections_are_projected_by_their_own_system(spark):
    zone = geo.STATE_PLANE[32139]
    x, y = lambert_forward(-97.25, 30.75, zone)
    tower = (-79.387139, 43.642567)  # known to lie at 630084 east, 4833438 north of zone 17
    rows = [
        ("NAD83", 4269, -97.25, 30.75), ("NAD83", 4269, *tower), ("NAD83 / Conus Albers", 5070, 5.0, 6.0),
        ("NAD83 / Texas Central", 32139, x, y), ("NAD_1983_StatePlane", 2277, x / geo.US_FOOT, y / geo.US_FOOT),
        ("NAD83 / UTM 17N", 26917, 630084.0, 4833438.0), ("WGS 84", 4326, 1.0, 2.0), ("NAD83", 4269, None, 1.0),
    ]
    df = spark.createDataFrame(rows, "crs_name string, epsg int, px double, py double")
    got = [(r.epsg, r.px, r.py) for r in conflation.consolidate_xs(df, "px", "py").collect()]
    assert len(got) == 7 and (5070, 5.0, 6.0) in got and sum(px is None for _, px, _ in got) == 1
    known = {(e, i): (px, py) for i, (e, px, py) in enumerate(got)}
    for other in ((32139, 3), (2277, 4)):
        assert known[other] == pytest.approx(known[(4269, 0)], abs=1e-4)
    assert known[(26917, 5)] == pytest.approx(known[(4269, 1)], abs=1.5)
    with pytest.raises(PySparkException, match="no projection for EPSG code 2256"):
        conflation.consolidate_xs(spark.createDataFrame([("NAD83 / Montana", 2256, 1.0, 1.0)], df.schema), "px", "py").collect()


def test_no_section_vanishes(spark):
    rows = [
        (1, "NAD83", 4269, -97.25, 30.75), (2, None, 4269, -97.25, 30.75), (3, "GRS 1980 degrees", 4269, -97.25, 30.75),
        (4, None, 5070, 5.0, 6.0), (5, "WGS 84", 4326, 1.0, 2.0), (6, "WGS 84", None, 1.0, 2.0), (7, "WGS 84", 5070, None, 2.0),
    ]
    df = spark.createDataFrame(rows, "id int, crs_name string, epsg int, px double, py double")
    got = {r.id: r for r in conflation.consolidate_xs(df, "px", "py").collect()}
    left = conflation.unprojected_xs(df).collect()
    assert sorted(got) == [1, 2, 3, 4, 7] and {r.crs for r in got.values()} == {"EPSG:5070"}
    assert (got[1].px, got[1].py) == (got[2].px, got[2].py) == (got[3].px, got[3].py) and abs(got[1].px) > 1000
    assert sorted((r.id, r.epsg, r.px, r.crs) for r in left if r.epsg) == [(5, 4326, 1.0, None)] and len(left) == 2
    for name, code in ((None, 4326), ("NAD83", None), (None, None)):
        with pytest.raises(PySparkException, match="no projection for EPSG code"):
            conflation.consolidate_xs(spark.createDataFrame([(1, name, code, 1.0, 1.0)], df.schema), "px", "py").collect()


def test_layer_mean_skips_missing_and_defaults_to_zero(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, None)], "divide_id string, `mean.x_1` double, `mean.x_2` double")
    got = df.select(params.layer_mean(df, "mean.x").alias("m"), params.layer_mean(df, "none").alias("z")).collect()
    assert [(r.m, r.z) for r in got] == [(1.0, 0.0), (None, 0.0)]


def test_unsupported_model_options_raise(spark):
    empty = {"divide-attributes": spark.createDataFrame([], "divide_id string")}
    with pytest.raises(ValueError, match="cannot be coupled"):
        params.params_smp(empty, "HBV")
    with pytest.raises(ValueError, match="CFE has the versions"):
        params.params_cfe(empty, empty["divide-attributes"], "CFE-Z")
    with pytest.raises(ValueError, match="divide attributes lack"):
        params.params_cfe(empty, empty["divide-attributes"], "CFE-S")
    with pytest.raises(ValueError, match="no configuration format"):
        bmi.render_bmi_configs(empty["divide-attributes"], "topoflow")


def test_snow17_document(spark):
    attributes = spark.createDataFrame([("cat-1", 123400.0, 0.0, 0.0)], "divide_id string, `mean.elevation` double, centroid_x double, centroid_y double")
    divides = spark.createDataFrame([("cat-1", 12.5)], "divide_id string, areasqkm double")
    document = bmi.render_bmi_configs(params.params_snow17({"divide-attributes": attributes, "divides": divides}), "snow17")
    row = document.collect()[0]
    assert row.file_name == "cat-1_bmi_config_snow17.txt"
    lines = row.content.split("\n")
    assert lines[:2] == ["hru_id: cat-1", "hru_area: 12.5"] and lines[3] == "elev: 1234.0"
    assert lines[4:9] == ["scf: 1.1", "mf_max: 1.0", "mf_min: 0.2", "uadj: 0.05", "si: 500.0"]
    assert lines[-1] == "adc11: 1.0" and len(lines) == 26


@pytest.fixture(scope="module")
def catchment(spark):
    names = [*params.CFE_ATTRIBUTES.values(), "mode.ISLTYP", "mode.IVGTYP", "mean.elevation", "mean.slope", "circ_mean.aspect"]
    values = {name: 0.5 + i for i, name in enumerate(names)}
    values.update({"mode.IVGTYP": 16.0, "mode.ISLTYP": 7.0, "mean.elevation": 50000.0, "centroid_x": 0.0, "centroid_y": 0.0})
    columns = [F.lit(v).alias(n) for n, v in values.items()]
    twi = F.lit('[{"v":0.6137,"frequency":0.2501},{"v":2.558,"frequency":0.2499}]').alias("dist_4.twi")
    one = spark.range(1)
    return {
        "divide-attributes": one.select(F.lit("g").alias("basin"), F.lit("cat-1").alias("divide_id"), *columns, twi),
        "divides": one.select(F.lit("g").alias("basin"), F.lit("cat-1").alias("divide_id"), F.lit(2.0).alias("areasqkm"), F.lit(1.2345).alias("lengthkm")),
    }


def document(df, module):
    (row,) = bmi.render_bmi_configs(df, module).collect()
    assert (row.basin, row.catchment, row.module) == ("g", "cat-1", module)
    return row.content.split("\n")


def test_documents_of_all_models(spark, catchment):
    calibrated = spark.createDataFrame([("cat-1", -0.2, 0.66, 0.00002)], "divide_id string, " + ", ".join(f"{n} double" for n in params.XINANJIANG))
    noah = document(params.params_noah_owp(catchment), "noahowp")
    assert "isltyp=7.0" in noah and "vegtyp=16" in noah and "sfctyp=2" in noah and noah[-1] == "zwt=-2.0 [m]"
    assert noah[0] == "dt=3600.0 [s]" and "dzsnso=0.0,0.0,0.0,0.1,0.3,0.6,1.0 [m]" in noah and len(noah) == 46
    ueb = document(params.params_ueb(catchment), "ueb")
    height = 6356766 * 500 / (6356766 + 500)
    pressure = round(101325 * (1 - 0.0065 * height / 288.15) ** (9.80665 / (0.0065 * 287.05287)), 4)
    assert ueb[4] == "elevation: 500.0" and ueb[5] == f"standard_atm_pressure: {pressure}" and ueb[-1] == "dec_temp_range: 10.71597"
    lstm = document(params.params_lstm(catchment), "lstm")
    assert lstm[:3] == ["area_sqkm: 2.0", "basin_id: g", "basin_name: "] and lstm[-1] == "verbose: 0"
    lasam = document(params.params_lasam(catchment, True), "lasam")
    assert "use_closed_form_G=False" in lasam and "sft_coupled=True" in lasam and lasam[-1] == "soil_z=10,30,100.0,200.0[cm]"
    cfe = document(params.params_cfe(catchment, calibrated, "CFE-X"), "cfe")
    assert "x_Xinanjiang_shape_parameter: 2e-05" in cfe and "urban_decimal_fraction: 0.01" in cfe and "nash_storage: 0.0,0.0" in cfe
    top = document(params.params_topmodel(catchment), "topmodel")
    assert "twi=[{'v': 0.6137, 'frequency': 0.2501}, {'v': 2.558, 'frequency': 0.2499}]" in top
    assert "num_topodex_values=2" in top and "dist_from_outlet=1234.0" in top and "t0=7.5e-05" in top
    troute = document(params.params_troute(catchment), "troute")
    assert "'geo_file_path': 'gauge_g.gpkg'" in troute[2] and len(troute) == 5
    assert document(params.params_smp(catchment), "smp")[0] == "verbosity=none"
    assert document(params.params_sacsma(catchment), "sacsma")[1] == "hru_area: 2.0"


def test_divides_without_calibration_disappear(spark, catchment):
    other = spark.createDataFrame([("cat-9", *[1.0] * 11)], "divide_id string, " + ", ".join(f"{n} double" for n in params.SACSMA_CALIBRATED))
    assert params.params_sacsma(catchment, other).isEmpty()
    assert params.params_sacsma(catchment).count() == 1


def square(x, y, size):
    corners = [x, y, x + size, y, x + size, y + size, x, y + size, x, y]
    return struct.pack("<BIII10d", 1, 3, 1, 5, *corners)


def test_cells_find_their_polygon_and_holes_are_outside(spark):
    ring = lambda x, y, s: [x, y, x + s, y, x + s, y + s, x, y + s, x, y]
    holed = struct.pack("<BIII10dI10d", 1, 3, 2, 5, *ring(0, 0, 10), 5, *ring(4, 4, 2))
    shapes = [(1, holed), (2, square(8, 8, 4)), (3, square(100, 100, 0.5)), (4, square(-64, -64, 300))]
    polygons = spark.createDataFrame(shapes, "cat_id bigint, geometry binary")
    polygons = polygons.withColumn("b", geo.wkb_bounds("geometry")).select("cat_id", "geometry", "b.*")
    points = [(5.0, 5.0), (1.5, 1.5), (9.1, 9.2), (100.2, 100.3), (900.0, 1.0), (-30.0, 7.0)]
    cells = spark.createDataFrame(points, "x double, y double")
    without_cover = zonal.cells_in_polygons(cells, polygons.where("cat_id < 4"))
    got = {(r.x, r.y): r.cat_id for r in without_cover.collect()}
    assert got == {(1.5, 1.5): 1, (9.1, 9.2): 2, (100.2, 100.3): 3}
    covered = zonal.cells_in_polygons(cells, polygons)
    assert {r.cat_id for r in covered.collect()} == {4} and covered.count() == 5


def test_zonal_statistics_of_special_values(spark):
    rows = [("a", -4.0, 1.0), ("a", -1.0, 1.0), ("b", -1.0, 1.0), ("b", 1.0, 1.0), ("c", 350.0, 1.0), ("c", 10.0, 1.0), ("d", None, 1.0)]
    cells = spark.createDataFrame(rows, "divide_id string, value double, weight double")
    geom = {r[0]: r[1] for r in zonal.zonal(cells, "geom_mean").collect()}
    assert geom["a"] == pytest.approx(-2.0) and geom["b"] is None and geom["d"] is None
    circ = {r[0]: r[1] for r in zonal.zonal(cells, "circ_mean").collect()}
    assert min(circ["c"], 360 - circ["c"]) == pytest.approx(0.0, abs=1e-9)
    mode = {r[0]: r[1] for r in zonal.zonal(cells, "mode").collect()}
    assert mode == {"a": -4.0, "b": -1.0, "c": 10.0}


def test_ties_between_catchments_are_kept_and_empty_ones_dropped(spark):
    rows = [(1, 10, 2.0), (1, 11, 2.0), (1, 12, 1.0), (2, None, 9.0), (2, 10, 1.0)]
    weights = spark.createDataFrame(rows, "IDmask int, cat_id int, sumwt double")
    got = sorted((r.ComID, r.cat_id) for r in zonal.dominant_catchment(weights).collect())
    assert got == [(1, 10), (1, 11)]


def test_clip_at_zero_is_a_bound(spark):
    cells = spark.createDataFrame([(-1.0, 0.0), (0.0, 0.0), (5.0, 5.0)], "x double, y double")
    assert zonal.clip_cells(cells, min_x=0).count() == 2
    assert zonal.clip_cells(cells).count() == 3


def test_snapshots(spark, shared):
    first = spark.createDataFrame([(1, "a")], "k int, v string")
    more = spark.createDataFrame([(2, "b", 1.5)], "k int, v string, w double")
    root = f"{shared}/t"
    assert versions.append_snapshot(first, root) == 1
    versions.tag_snapshot(spark, root, 1, "base")
    assert versions.append_snapshot(more, root) == 2
    assert versions.overwrite_snapshot(first, root) == 3
    assert sorted((r.k, r.w) for r in versions.as_of(spark, root, 2).collect()) == [(1, None), (2, 1.5)]
    assert versions.as_of(spark, root).count() == 1
    assert versions.back_n(spark, root, 1).count() == 2
    assert versions.as_of(spark, root, tag="base").columns == ["k", "v"]
    assert [r.snapshot_id for r in versions.history(spark, root).collect()] == [3, 2, 1]
    assert [(r.tag, r.snapshot_id) for r in versions.tags(spark, root).collect()] == [("base", 1)]
    for broken in (lambda: versions.back_n(spark, root, 9), lambda: versions.as_of(spark, root, 9), lambda: versions.as_of(spark, root, tag="x")):
        with pytest.raises(ValueError):
            broken()
