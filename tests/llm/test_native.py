"""Exact deduplication, mixing and decontamination against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rillflow.llm.decontaminate import benchmark_matches, simhash
from rillflow.llm.exact_dedup import exact_duplicates
from rillflow.llm.mixing import poisson_mix, target_rates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected_duplicates(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = (max(ids) if ids else None) if len(groups[lower(t)]) > 1 else i
        out.append((i, keep, len(groups[lower(t)]), i is not None and i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return Counter(out)


LONG = " ".join(random.Random(5).choices(["alpha", "beta", "é", "ñandú", "gamma\n", "x" * 30], k=9000))
TEXTS = [(1, "Ab c"), (2, "aB C"), (3, None), (4, ""), (5, LONG), (6, LONG.upper().replace("É", "é").replace("Ñ", "ñ").replace("Ú", "ú")),
         (7, LONG + "!"), (None, "ab c"), (None, "lonely"), (8, "É"), (9, "é"), (2, "aB C"), (10, "x" * 20_000), (11, "x" * 20_001)]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(spark, weak):
    """With three fingerprints for all chunks the ranks decide."""
    fingerprint = (lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("long")) if weak else F.xxhash64
    df = docs(spark, [(i, t, "s") for i, t in TEXTS]).withColumn("recipe", F.lit(1)).withColumn("group_size", F.lit("x"))
    got = exact_duplicates(df, fingerprint)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == expected_duplicates(TEXTS)


def test_exact_duplicates_of_nothing(spark):
    assert exact_duplicates(docs(spark, [])).count() == 0


def test_chunks_are_the_text(spark):
    from rillflow.llm.exact_dedup import chunks

    rows = docs(spark, [(i, t, "s") for i, t in TEXTS if t]).select("text", chunks(F.col("text")).alias("c")).collect()
    assert all("".join(r.c) == r.text for r in rows) and max(len(r.c) for r in rows) > 10


def test_mix_reaches_target_shares_and_keeps_columns(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else "small") for i in range(4000)] + [(None, None, None)] * 2
    df = docs(spark, rows).withColumn("copy", F.lit(7)).withColumn("rate", F.lit("mine")).withColumn("cdf", F.lit(0))
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("absent", 5.0)], "source string, weight double")
    mixed = poisson_mix(df, target_rates(df, weights))
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert set(counts) == {"big", "small"}
    assert abs(counts["big"] - 2000) < 200 and abs(counts["small"] - 2000) < 300
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate", "cdf", "copy", "shuffle_key"]
    copies = Counter((r.doc_id, r.copy) for r in mixed.collect())
    assert max(copies.values()) == 1
    for (i, c) in copies:
        assert c == 1 or (i, c - 1) in copies
    again = poisson_mix(df.repartition(3), target_rates(df, weights))
    assert Counter((r.doc_id, r.copy, r.shuffle_key) for r in again.collect()) == Counter((r.doc_id, r.copy, r.shuffle_key) for r in mixed.collect())


def test_mix_of_null_source_and_of_nothing(spark):
    df = docs(spark, [(i, None, None) for i in range(300)])
    assert 200 < poisson_mix(df, target_rates(df)).count() < 400
    assert poisson_mix(docs(spark, []), target_rates(docs(spark, []))).count() == 0


def test_rates_keep_or_level_the_mixture(spark):
    df = docs(spark, [(i, None, "a" if i < 90 else "b") for i in range(100)])
    assert {r.source: round(r.rate, 9) for r in target_rates(df, temperature=1.0).collect()} == {"a": 1.0, "b": 1.0}
    assert {r.source: round(r.rate, 9) for r in target_rates(df, temperature=0.0).collect()} == {"a": round(50 / 90, 9), "b": 5.0}


def test_benchmark_matches(spark):
    word = random.Random(3)
    item = [f"w{word.randrange(10**6)}" for _ in range(40)]
    other = [f"v{i}" for i in range(30)]
    pad = [f"p{i}" for i in range(50)]
    edited = item[:20] + ["new"] + item[21:]
    far = [w if i % 4 else "new" for i, w in enumerate(item)]
    rows = [
        (1, pad + item + pad), (2, pad), (3, [w.upper() + "," for w in item]), (4, edited + pad), (5, far + pad), (6, item[:20]),
        (7, pad + other + item), (8, ["three", "short", "words"]), (9, pad + ["three", "short", "words"] + pad), (None, item),
        (10, pad * 300 + item + pad * 300), (1, pad + item), (11, ["same"] * 400),
    ]
    df = docs(spark, [(i, " ".join(t), "s") for i, t in rows] + [(20, None, "s"), (21, "", "s")]).withColumn("item_id", F.lit(1)).withColumn("start", F.lit(9))
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, "Three  short\nwords"), (4, None), (5, "  "), (None, "p1 p2 p3 p4 p5 p6"), (6, "same " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 6)) for r in benchmark_matches(df, bench).collect()}
    assert got == {
        (1, 1): (0 + 50, 1.0), (3, 1): (0, 1.0), (4, 1): (0, round(31 / 41, 6)), (7, 1): (80, 1.0), (7, 2): (50, 1.0),
        (8, 3): (0, 1.0), (9, 3): (50, 1.0), (10, 1): (15000, 1.0), (11, 6): (0, 1.0),
    }
    assert benchmark_matches(docs(spark, []), bench).count() == 0
    assert benchmark_matches(df, bench.limit(0)).count() == 0


def bag(words):
    k = min(len(words), 5)
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def expected_matches(rows, items, percent=75):
    """The best window of every document and item, over every start."""
    out = {}
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, t in rows:
        for j, u in items:
            doc, item = words(t), words(u)
            if i is None or j is None or not item or len(doc) < min(len(item), 5):
                continue
            k, want = min(len(item), 5), bag(item)
            for start in range(max(len(doc) - len(item), 0) + 1):
                window = doc[start : start + len(item)]
                have = Counter(tuple(window[a : a + k]) for a in range(len(window) - k + 1))
                common = (have & want).total()
                joint = (have | want).total()
                if 100 * common >= percent * joint and out.get((i, j), (0, 0))[0] < common / joint:
                    out[i, j] = (common / joint, start)
    return out


def test_benchmark_matches_over_every_start(spark):
    """Copies of items with words put in, taken out and changed, up to the threshold itself."""
    draw = random.Random(8)
    items = [(j, " ".join(f"w{draw.randrange(3000)}" for _ in range(n))) for j, n in enumerate([16, 17, 30, 44, 44, 60, 60, 90, 4, 2])]
    items += [(20, "la " * 30), (21, "do re mi " * 12), (22, " ".join(items[5][1].split()[:44]))]
    rows = []
    for i in range(150):
        text = draw.choice(items[:8])[1].split()
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(text) + 1)
            text[at : at + draw.choice([0, 1])] = [f"x{draw.randrange(9)}"] * draw.choice([0, 1, 2, 4])
        rows.append((i, " ".join([f"p{k}" for k in range(draw.choice([0, 3, 80]))] + text + [f"q{k}" for k in range(draw.choice([0, 80]))])))
    item = items[6][1].split()
    inserted = [w for k, x in enumerate(item) for w in ([f"new{k}", f"more{k}"] if k in (1, 2, 58) else []) + [x]]
    rows += [(200, " ".join(["pad"] * 9 + inserted + ["pad"] * 9)), (201, "la " * 25), (202, "re mi do " * 40), (203, items[8][1]), (204, "")]
    df = docs(spark, [(i, t, "s") for i, t in rows]).withColumns({c: F.lit(1) for c in ("n", "hits", "need", "bag", "starts", "words", "copy")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in benchmark_matches(df, bench).collect()}
    want = expected_matches(rows, items)
    assert got == want and len(want) > 80 and min(s for s, _ in want.values()) < 0.77


def test_simhash_is_the_majority_of_each_bit(spark):
    draw = random.Random(4)
    bags = [[draw.randrange(-(2**63), 2**63) for _ in range(n)] for n in (1, 2, 5, 40)]
    got = spark.createDataFrame([(b,) for b in bags], "b array<long>").select("b", simhash(F.col("b")).alias("s")).collect()
    for r in got:
        assert r.s % 2**64 == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in r.b) > len(r.b))
