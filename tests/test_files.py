import gzip
import json
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow import sinks
from rillflow.catalogue import models, sections, series
from rillflow.schemas import contract
from rillflow.sources import files, grids, tables


def write(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_newest_gauge_file_counts(spark, tmp_path):
    root = str(tmp_path)
    write(root, "ENVCA/2024-01/05AA_hourly.csv", "dateTime,q_cms\n2024-01-01T00:00:00-05:00,1.0\n")
    write(root, "ENVCA/2024-02/05AA_hourly.csv", "dateTime,q_cms\n2024-01-01T00:00:00-05:00,2.0\n2024-01-01 01:00,3.0\n")
    write(root, "USGS/2024-01/081.csv", "dateTime,q_cms\n2024-01-01,4.0\n")
    rows = files.read_gage_csvs(spark, root, "dateTime string, q_cms double").orderBy("q_cms").collect()
    assert [(r.id, r.gage_type, str(r.time), r.q_cms) for r in rows] == [
        ("05AA", "ENVCA", "2024-01-01 05:00:00", 2.0),
        ("05AA", "ENVCA", "2024-01-01 01:00:00", 3.0),
        ("081", "TXDOT", "2024-01-01 00:00:00", 4.0),
    ]


def test_conflation_files_and_unreadable_ones(spark, tmp_path):
    root = str(tmp_path)
    end = {"river": "R", "reach": "A", "xs_id": 12.5, "min_elevation": 1.0, "max_elevation": 2.0, "metrics": {"low_flow": 1}}
    document = {"reaches": {"100": {"us_xs": end, "network_to_id": "7"}, "101": {"ds_xs": end, "network_to_id": "8"}}, "metrics": {}}
    write(root, "huc_12090301/models/m1/conflation.json", json.dumps(document))
    write(root, "huc_12090301/models/m2/conflation.json", "{not json")
    rows = {r.reach_id: r for r in files.read_conflation_json(spark, root).collect()}
    assert set(rows) == {"100", "101"}
    assert (rows["100"].model_id, rows["100"].huc, rows["100"].us_xs.xs_id) == ("m1", "12090301", "12.5")
    assert rows["100"].ds_xs is None and rows["101"].network_to_id == "8"


def test_marked_csv_with_quotes_in_any_column_order(spark, tmp_path):
    text = 'Title, "a, b"\n\n#SERIES DATA#\n"Location",Result,"Datetime (UTC)"\n"Lake, upper",1.5,2024-01-01\n"Lake",,2024-01-02\n'
    write(str(tmp_path), "one.csv", text)
    rows = files.read_marked_csv(spark, str(tmp_path), {"Datetime (UTC)": "string", "Result": "double", "Location": "string"})
    got = [(r["Datetime (UTC)"], r.Result, r.Location) for r in rows.orderBy("row_no").collect()]
    assert got == [("2024-01-01", 1.5, "Lake, upper"), ("2024-01-02", None, "Lake")]


def test_csv_without_marker_fails(spark, tmp_path):
    write(str(tmp_path), "one.csv", "a,b\n1,2\n")
    with pytest.raises(Exception, match="not found in"):
        files.read_marked_csv(spark, str(tmp_path), {"a": "string"}).collect()


def test_default_tables_with_different_headers(spark, tmp_path):
    write(str(tmp_path), "a_params.csv", "name,calibratable,default_value,source_file \nx,True,1,\ny,FALSE,2,\n")
    write(str(tmp_path), "b_params.csv", "name,calibratable,nwm_name\nz,TRUE,q\n")
    write(str(tmp_path), "modules.csv", "module,file\n")
    table = files.read_param_defaults(spark, str(tmp_path))
    assert sorted((r.module, r.name, r.default_value, r.nwm_name) for r in table.collect()) == [
        ("a", "x", "1", None), ("a", "y", "2", None), ("b", "z", None, "q"),
    ]


def test_geopackages_without_the_layer_give_nothing(spark):
    packages = models.geopackages(spark, "/root/testdata/sf0.001")
    assert files.gpkg_rows(packages, "lakes", models._GPKG_SCHEMA).count() == 0
    rows = files.gpkg_rows(packages, "divides", models._GPKG_SCHEMA)
    assert rows.count() == 2 * rows.select("divide_id").distinct().count()


def test_contract_refuses_null_keys_and_skips_missing_files(spark, shared):
    assert tables.read_contract(spark, f"{shared}/none", "pois") is None
    rows = [(1, "wb-1", None, "01")]
    spark.createDataFrame(rows, "poi_id int, id string, nex_id string, vpuid string").write.parquet(f"{shared}/pois")
    with pytest.raises(ValueError, match="1 null values of nex_id"):
        tables.read_contract(spark, f"{shared}/pois", "pois")
    assert tables.read_contract(spark, f"{shared}/pois", "pois", check=False).schema.names == contract("pois").names


def test_unsupported_types_are_refused(spark):
    with pytest.raises(ValueError, match="Unsupported type"):
        tables.normalize_schema(spark.range(1).select(F.current_date().alias("d")))
    assert tables.normalize_schema(spark.range(1).select(F.col("id").cast("int"))).schema["id"].dataType == T.LongType()


def test_timeseries_as_csv(spark, tmp_path, shared):
    df = spark.sql("SELECT timestamp_ntz'2021-12-31 14:00:00' AS time, 1.5D AS q_cms")
    sinks.write_timeseries(df, f"{shared}/out", "csv", header=False)
    parts = [p for p in os.listdir(tmp_path / "out") if p.endswith(".csv")]
    assert (tmp_path / "out" / parts[0]).read_text() == "2021-12-31 14:00:00,1.5\n"
    with pytest.raises(ValueError, match="unknown format"):
        sinks.write_timeseries(df, f"{shared}/x", "xml")


def test_dates_from_raster_file_names(spark, shared):
    spark.range(2).write.parquet(f"{shared}/grids/20240131_ldasin")
    got = grids.concat_time(spark, f"{shared}/grids").select("date").distinct().collect()
    assert [str(r.date) for r in got] == ["2024-01-31"]


def test_a_marked_file_larger_than_a_split(spark, tmp_path):
    """Many splits of one file, the marker near the end of one of them, beside files of one split; no file is one string."""
    rows = [f'"L{i}, x",{i}.5,2024-01-01' for i in range(3000)]
    write(str(tmp_path), "big.csv", "a,b\n" * 700 + "#SERIES DATA#\r\nLocation,Result,Day\n" + "\n".join(rows) + "\n\n")
    write(str(tmp_path), "deep/er/small.csv", "#SERIES DATA#\nDay,Result\n2024-02-01,7\n#SERIES DATA#\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1111")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() >= 1 and lines.where("line_no = 700").select("value").first()
        numbers = sorted((r.path.rsplit("/", 1)[1], r.line_no) for r in lines.collect())
        assert numbers == [("big.csv", i) for i in range(3703)] + [("small.csv", i) for i in range(4)]
        got = files.read_marked_csv(spark, str(tmp_path), {"Day": "string", "Result": "double"}).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    big = sorted((r.row_no, r.Result, r.Day) for r in got if r.path.endswith("big.csv"))
    assert big == [(i, i + 0.5, "2024-01-01") for i in range(3000)]
    assert [(r.row_no, r.Result, r.Day) for r in sorted(got, key=lambda r: r.row_no) if r.path.endswith("small.csv")] == [(0, 7.0, "2024-02-01"), (1, None, "#SERIES DATA#")]


def test_dates_come_from_the_name_of_the_file_alone(spark, shared):
    cells = spark.createDataFrame([(1, 2.0)], "x int, value double")
    cells.withColumn("of", F.lit("lc_20110101.tif")).write.partitionBy("of").parquet(f"{shared}/run-19990909/grids")
    assert [str(r.date) for r in grids.concat_time(spark, f"{shared}/run-19990909/grids").select("date").collect()] == ["2011-01-01"]


def test_many_small_files_are_written_by_all_tasks_and_opened_once(spark, shared):
    rows = spark.range(64).select(F.concat(F.lit("s"), "id").alias("station"), F.lit(0).alias("at"), F.lit("dateTime,q").alias("value"))
    rows = rows.unionAll(rows.withColumns({"at": F.lit(1), "value": F.lit("2024-01-01 00:00:00+00:00,1.5")}))
    sinks.many_files(rows, ["station"], "at").option("compression", "none").text(f"{shared}/many")
    found = spark.read.option("recursiveFileLookup", "true").text(f"{shared}/many").select(F.col("_metadata.file_path").alias("p")).distinct().collect()
    assert len(found) == 64 and len({r.p.rpartition("/")[2].split("-")[1] for r in found}) > 8

    spark.range(3).select(F.lit("2024-01-01 00:00:00+00:00").alias("dateTime"), F.col("id").cast("double").alias("q")).write.option("header", "true").csv(f"{shared}/gages/USGS/2024/G1_1.csv")
    read = files.read_gage_csvs(spark, f"{shared}/gages", "dateTime string, q double", written=True)
    assert read.count() == 3
    assert "csv" not in read.select("q").inputFiles()[0].rpartition("/")[2] and "FileScan csv" not in read._jdf.queryExecution().executedPlan().toString()
    lines = files.numbered_lines(spark, f"{shared}/many")
    assert "FileScan text" not in lines._jdf.queryExecution().executedPlan().toString()
    assert sorted({r.line_no for r in lines.collect()}) == [0, 1]


def test_a_gauge_is_a_file_that_its_task_writes_by_its_name(spark, shared, monkeypatch):
    """No folder, checksum or unfinished file beside it; a store that Arrow doesn't know gets the folders of Spark's writer."""
    monkeypatch.setattr(series, "new_path", lambda spark, name: f"{shared}/{name}")
    rows = sorted(map(tuple, series.read_gage_csvs(spark, "/root/testdata/sf0.001").collect()), key=str)
    root = shared.removeprefix("file://")
    found = [os.path.relpath(os.path.join(d, f), f"{root}/gages") for d, _, names in os.walk(f"{root}/gages") for f in names]
    assert len(found) > 10 and all(re.fullmatch(r"(ENVCA|CADWR|USGS)/2024-0[12]/G\d+_\d+\.csv", f) for f in found)
    monkeypatch.setattr(series, "new_path", lambda spark, name: f"{shared}/again/{name}")
    monkeypatch.setattr(series, "arrow_opens", lambda root: False)
    assert rows == sorted(map(tuple, series.read_gage_csvs(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert not sinks.arrow_opens("viewfs://store/in") and sinks.arrow_opens(shared)


def test_small_files_are_read_by_few_tasks(spark, shared):
    for i in range(300):
        write(shared.removeprefix("file://"), f"gages/USGS/2024/G{i}_{i}.csv", f"dateTime,q\n2024-01-01 00:00:00+00:00,{i}.5\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5m")  # a file counts as 4 MB
    try:
        read = files.read_gage_csvs(spark, f"{shared}/gages", "dateTime string, q double")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r.q for r in read.collect()) == [i + 0.5 for i in range(300)]
    assert len(read.select("q").inputFiles()) <= 4 * spark.sparkContext.defaultParallelism


def test_named_files_are_whole_and_written_again_by_a_second_attempt(spark, shared):
    """Lines of a file stay together over blocks and tasks; a missing name is Spark's; a file left unfinished isn't read."""
    root = shared.removeprefix("file://") + "/named"
    rows = spark.range(0, 4000, 1, 7).select(
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 4)).alias("gauge"),
        F.when(F.col("id") % 2 == 0, "a.csv").otherwise("a.csv.gz").alias("file"),
        F.concat(F.col("id"), F.lit(","), F.repeat(F.lit("x"), 1000)).alias("value"),
    )
    for _ in range(2):
        sinks.named_files(rows, ["gauge", "file"], f"file://{root}", "id,x")
    write(root, "g1/_a.csv.0123", "id,x\n-1,x\n")
    names = {"gauge=__HIVE_DEFAULT_PARTITION__/a.csv", "g1/_a.csv.0123", "g1/a.csv.gz", "g2/a.csv", "g3/a.csv.gz"}
    assert {os.path.relpath(os.path.join(d, f), root) for d, _, found in os.walk(root) for f in found} == names
    assert len(set(sinks._blocks(["x" * 1000] * 2500))) > 1
    read = spark.read.schema("id long, x string").option("header", "true").option("recursiveFileLookup", "true").csv(root)
    assert sorted((r.id, len(r.x)) for r in read.collect()) == [(i, 1000) for i in range(4000)]


def test_conflation_documents_are_packed_files_dealt_out_once(spark, shared, monkeypatch):
    """Sections are shuffled once for their documents, which take a fraction of their text on disk; either writer gives the rows."""
    sf, got = "/root/testdata/sf0.001", []
    documents = sections.conflation(spark, sf)
    assert documents._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    texts = {(r.huc, r.model): r.value for r in documents.collect()}
    assert len(texts) == documents.count() and all(list(json.loads(t)["reaches"]) == sorted(json.loads(t)["reaches"]) for t in texts.values())
    for by_arrow in (True, False):
        monkeypatch.setattr(sections, "arrow_opens", lambda root, by_arrow=by_arrow: by_arrow)
        monkeypatch.setattr(sections, "new_path", lambda spark, name, by_arrow=by_arrow: f"{shared}/{by_arrow}/{name}")
        got.append(sorted(map(str, sections.read_conflation_json(spark, sf).collect())))
    assert got[0] == got[1] and len(got[0]) > 1000
    root = shared.removeprefix("file://") + "/True/conflation"
    found = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names]
    assert len(found) == len(texts) and all(re.fullmatch(r"huc_\d+/source_models/model-\d+-\d+/conflation\.json\.gz", os.path.relpath(f, root)) for f in found)
    assert sum(map(os.path.getsize, found)) * 2 < sum(map(len, texts.values()))


def test_packed_and_plain_conflation_files_are_read(spark, tmp_path):
    text = json.dumps({"reaches": {"100": {"network_to_id": "7"}}})
    write(str(tmp_path), "huc_1/models/plain/conflation.json", text)
    write(str(tmp_path), "huc_1/models/packed/notes.txt.gz", "no document")
    with gzip.open(tmp_path / "huc_1/models/packed/conflation.json.gz", "wt") as out:
        out.write(text.replace("100", "101") + "\n")
    rows = files.read_conflation_json(spark, str(tmp_path)).collect()
    assert sorted((r.model_id, r.reach_id) for r in rows) == [("packed", "101"), ("plain", "100")]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(100):
        write(str(tmp_path), f"huc_1/models/m{i}/conflation.json", '{"reaches": {"%d": {"network_to_id": "7"}}}' % i)
    setting = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        rows = files.read_conflation_json(spark, str(tmp_path))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    seen = spark.sparkContext.statusTracker()
    stages = [s for job in seen.getJobIdsForGroup("listing") for s in seen.getJobInfo(job).stageIds]
    tasks = [seen.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == setting
    assert sorted(int(r.reach_id) for r in rows.collect()) == list(range(100))
