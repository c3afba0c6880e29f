"""Basin sums and routing segments as ranges of numbers, against their row-by-row meaning."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillflow.operators import routing, subset, totals
from rillflow.plans import graph as gr
from rillflow.plans.ranking import running

VPUS = ["01", "08", "11", "05"]
SCOPE = {"08": {"11", "10U", "10L", "08", "07", "05"}}


def test_running_sums_and_maxima_of_hot_and_null_groups(spark):
    draw = random.Random(3)
    rows = [("hot" if i % 3 else draw.choice(["a", None]), draw.randrange(30), i, draw.choice([None, draw.randrange(99)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, at int, i int, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["g"], ["at", "i"], {"total": ("sum", "v"), "top": ("max", "v")}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, sums, tops = {}, defaultdict(lambda: None), defaultdict(lambda: None)
    for g, at, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        if v is not None:
            sums[g] = (sums[g] or 0) + v
            tops[g] = v if tops[g] is None else max(tops[g], v)
        want[i] = (sums[g], tops[g])
    assert {r.i: (r.total, r.top) for r in got} == want


def network(seed, n=120):
    """A forest whose catchments are shared, missing and doubled here and there, with neighbours at one nexus."""
    draw = random.Random(seed)
    down = {i: draw.randrange(max(0, i - 4), i) for i in range(1, n) if draw.random() > 0.04}
    vpu = {i: draw.choice(VPUS) for i in range(n)}
    nexus = {i: f"nex-{down[i]}" if i in down and draw.random() < 0.3 else f"nex-own{i}" for i in range(n)}
    flowpaths = [(f"wb-{i}", nexus[i]) for i in range(n)]
    divide = {i: f"cat-{i if draw.random() > 0.1 else draw.randrange(n)}" for i in range(n)}
    rows = [(f"wb-{i}", nexus[i], divide[i] if draw.random() > 0.05 else None, vpu[i]) for i in range(n)]
    rows += [(f"wb-{i}", nexus[i], f"cat-{draw.randrange(n)}", draw.choice(VPUS)) for i in draw.sample(range(n), 8)]
    rows += [(nexus[a], f"wb-{b}", None, vpu[a]) for a, b in down.items()]
    rows += [("wb-outside", "nex-x", "cat-3", "01"), ("wb-7", "wb-3", "cat-9", "01")]
    divides = [(f"cat-{i}", draw.choice(VPUS), draw.choice([None, i + 0.25])) for i in range(n)] + [("cat-5", "01", 7.5)]
    uris = [(f"wb-{draw.randrange(n)}", draw.choice([f"gages-{k}", f"gages-{k % 9}", None]), draw.choice(VPUS)) for k in range(60)]
    uris += [("nex-own4", "nid-4", "01"), ("wb-outside", "gages-out", "01")]
    return flowpaths, rows, divides, uris


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_basin_totals_equal_the_summary_of_listed_layers(spark, seed):
    flowpaths, rows, divides, uris = network(seed)
    layers = {
        "flowpaths": spark.createDataFrame(flowpaths, "id string, toid string"),
        "network": spark.createDataFrame(rows, "id string, toid string, divide_id string, vpuid string"),
        "divides": spark.createDataFrame(divides, "divide_id string, vpuid string, areasqkm double"),
        "hydrolocations": spark.createDataFrame(uris, "id string, hl_uri string, vpuid string"),
    }
    graph = gr.build_graph(layers["flowpaths"], layers["network"])
    draw = random.Random(seed)
    toid = dict(flowpaths)
    starts = [(f"b{i // 2}", f"wb-{k}", toid[f"wb-{k}"], draw.choice(VPUS)) for i, k in enumerate(draw.choices(range(120), k=80))]
    starts += [("b-out", "wb-outside", "nex-x", "01"), ("b0", "wb-outside", "nex-x", "08"), (None, "wb-1", None, "01")]
    origins = spark.createDataFrame(starts, "basin string, id string, toid string, vpuid string")
    layers["network"] = layers["network"].withColumn("poi_id", F.lit(1.0))
    full = {"flowpaths": layers["flowpaths"].withColumn("vpuid", F.lit("01")), **{k: v for k, v in layers.items() if k != "flowpaths"}}
    ids = subset.scoped_ids(graph, origins.where("basin is not null"))
    want = subset.basin_summary(subset.subset_layers(full, ids, ["hydrolocations"])).collect()
    got = totals.basin_totals(layers, graph, origins).collect()
    form = lambda r: (r.basin, r.catchments, None if r.areasqkm is None else round(r.areasqkm, 6), r.hydrolocations)
    assert Counter(map(form, got)) == Counter(map(form, want)) and len(got) > 20


def test_nested_gauges_on_a_long_stem_cost_no_row_for_each_pair(spark, monkeypatch):
    """200 gauges on a chain of 2,000: 200,000 pairs, which no table holds."""
    n, sizes = 2000, {}

    def counted(df, name):
        out = gr.materialize(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    chain = spark.range(1, n + 1)
    layers = {
        "flowpaths": chain.selectExpr("'wb-' || id AS id", "'nex-' || id AS toid"),
        "network": chain.selectExpr("'wb-' || id AS id", "'nex-' || id AS toid", "'cat-' || id AS divide_id", "'01' AS vpuid").unionAll(chain.selectExpr("'nex-' || id", "'wb-' || (id - 1)", "null", "'01'")),
        "divides": chain.selectExpr("'cat-' || id AS divide_id", "'01' AS vpuid", "0.5D AS areasqkm"),
        "hydrolocations": chain.where("id % 10 = 0").selectExpr("'wb-' || id AS id", "'gages-' || id AS hl_uri", "'01' AS vpuid"),
    }
    graph = gr.build_graph(layers["flowpaths"], layers["network"])
    monkeypatch.setattr(totals, "materialize", counted)
    origins = layers["hydrolocations"].selectExpr("hl_uri AS basin", "id", "replace(id, 'wb', 'nex') AS toid", "'01' AS vpuid")
    got = {r.basin: (r.catchments, r.areasqkm, r.hydrolocations) for r in totals.basin_totals(layers, graph, origins).collect()}
    assert got == {f"gages-{k}": (n - k + 1, (n - k + 1) / 2, (n - k) // 10 + 1) for k in range(10, n + 1, 10)}
    assert max(sizes.values()) <= 3 * n


def test_basin_totals_refuse_a_circle(spark):
    pair = "id string, toid string"
    flowpaths = spark.createDataFrame([("wb-1", "nex-1"), ("wb-2", "nex-2")], pair)
    graph = gr.build_graph(flowpaths, spark.createDataFrame([("nex-1", "wb-2"), ("nex-2", "wb-1")], pair))
    assert graph.cyclic
    with pytest.raises(ValueError, match="cycle"):
        totals.basin_totals({}, graph, None)


def stem(spark, rows, lakes):
    """rows: (hf_id, hydroseq, hf_hydroseq, mainstem, order, vpu, poi)."""
    network = spark.createDataFrame([(f"wb-{k}", f"nex-{k}", f"cat-{r[0]}", float(r[0]), float(r[1]), float(r[2]), float(r[3]), r[5], None if r[6] is None else float(r[6])) for k, r in enumerate(rows)],
                                    "id string, toid string, divide_id string, hf_id double, hydroseq double, hf_hydroseq double, hf_mainstem double, vpuid string, poi_id double")
    flowpaths = spark.createDataFrame([(f"wb-{k}", f"nex-{k}", f"cat-{r[0]}", float(r[4]), r[5], None if r[6] is None else str(r[6])) for k, r in enumerate(rows)],
                                      "id string, toid string, divide_id string, order double, vpuid string, poi_id string")
    lake = spark.createDataFrame(lakes, "poi_id int, hf_id double, vpuid string")
    return {"network": network, "flowpaths": flowpaths, "lakes": lake}


def expected_segments(rows, lakes):
    out = {}
    for hf, seq, _, main, order, vpu, _ in rows:
        scope = SCOPE.get(vpu, {vpu})
        below = [r for r in rows if r[3] == main and r[1] <= seq and r[5] in scope]
        same = [r for r in below if r[4] == order]
        on = {h for r in same for p, h, v in lakes if p == r[6] and v in scope}
        if on:
            cut = max((r[2] for r in below if float(r[0]) in on), default=None)
            same = [r for r in same if cut is not None and r[2] >= cut]
        out[hf] = {r[0] for r in same}
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_segments_equal_the_search_along_the_stem(spark, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(160):
        seq = draw.randrange(400)
        rows.append((k, seq, seq if draw.random() < 0.7 else draw.randrange(400), draw.randrange(4), draw.choice([1, 1, 2]), draw.choice(["01", "08", "11"]) if k % 3 else "08", draw.choice([None, None, k])))
    lakes = [(draw.randrange(160), float(draw.randrange(170)) if draw.random() < 0.4 else float(p), draw.choice(["01", "08", "11"])) for p in draw.sample(range(160), 40)]
    lakes += [(k, float(k), "08") for k in range(0, 160, 9)]
    segment = routing.rnr_segment(stem(spark, rows, lakes), spark.createDataFrame([(float(r[0]),) for r in rows], "hf_id double"))["flowpaths"]
    got = defaultdict(set)
    for r in segment.select("reach_id", "divide_id").collect():
        got[r.reach_id].add(int(r.divide_id[4:]))
    assert dict(got) == expected_segments(rows, lakes)


def test_a_long_stem_makes_rows_in_proportion(spark, monkeypatch):
    n, sizes = 2000, {}

    def counted(df, name):
        out = gr.materialize(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(routing, "materialize", counted)
    monkeypatch.setattr("rillflow.plans.ranking.materialize", counted)
    layers = stem(spark, [(k, k, k, 1, 1, "01", k if k % 500 == 0 else None) for k in range(1, n + 1)], [(k, float(k), "01") for k in range(500, n + 1, 500)])
    intervals, _ = routing.segment_intervals(layers, layers["network"].select("hf_id"))
    got = {r.reach_id: (r.first_row, r.last_row) for r in intervals.collect()}
    assert got == {k: (max(k - k % 500, 1), k) for k in range(1, n + 1)}
    assert max(sizes.values()) <= 3 * n
