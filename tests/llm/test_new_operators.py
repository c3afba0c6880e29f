"""Sharding, source divergence and whitening against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm import divergence, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names the operators use themselves."""
    df = spark.createDataFrame([(*r, None) for r in rows], DOCS)
    names = ["shard", "slot", "rank", "row", "high", "low", "key", "terms", "vector", "index", "p", "value", "x", "size"]
    return df.withColumns({n: F.lit("clash") for n in names})


# sharding


def walk(key, shards):
    """The published loop."""
    state, at, to = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16), -1, 0
    while to < shards:
        at = to
        state = (state * sharding.MULTIPLIER + 1) % 2**64
        to = int((at + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return at


SHARD_ROWS = [(i, random.Random(i).choice(["a", "é ", "x" * 3]) * (i % 40), "en", "s") for i in range(1500)] + [
    (None, "same", "en", "s"), (None, "same", "en", "s"), (None, None, None, None), (7, "seven", "en", "s"), (7, "seven", "en", "s"),
    (2**60 + 1, "a", "en", "s"), (2**60 + 2, "", "en", "s"), (-5, "word " * 50_000, "en", "s"), (2000, None, "en", "s")]


@pytest.mark.parametrize("shards", [1, 2, 24])
def test_shards_of_the_published_walk(spark, shards):
    got = sharding.shard_documents(docs(spark, SHARD_ROWS).repartition(7), shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    expected = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key", walk(i, shards), walk(i, shards + 1)) for i, t, *_ in SHARD_ROWS]
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows) == Counter(expected)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, shards)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard_documents(docs(spark, SHARD_ROWS).repartition(3), shards).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_next_state_is_exact_at_the_ends(spark):
    states = [0, 1, 2**32 - 1, 2**32, 2**63 - 1, 2**63, 2**64 - 1, 2**64 - 2**32]
    df = spark.createDataFrame([(s >> 32, s & (2**32 - 1)) for s in states], "h long, l long")
    high, low = sharding.next_state(F.col("h"), F.col("l"))
    got = [(r[0] << 32) + r[1] for r in df.select(high, low).collect()]
    assert got == [(s * sharding.MULTIPLIER + 1) % 2**64 for s in states]


def test_shards_of_nothing_and_of_one_key(spark):
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    rows = sharding.shard_documents(docs(spark, [(None, "copy", "en", "s")] * 500)).collect()
    assert len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(500))
    with pytest.raises(ValueError):
        sharding.shard_documents(docs(spark, []), 0)


def test_written_shards_hold_all_rows_and_columns(spark, shared):
    source = docs(spark, SHARD_ROWS)
    column = sharding.write_shards(source, f"{shared}/shards", 5)
    assert column == "_shard"
    back = spark.read.parquet(f"{shared}/shards")
    assert Counter(map(tuple, back.select(source.columns).collect())) == Counter(map(tuple, source.collect()))
    assert all(r[column] == walk(r.doc_id, 5) for r in back.select("doc_id", column).collect())


# source divergence


def expected_divergence(rows, least, ranks=50):
    words = [(l or "", s or "", [w for w in _words(t or "")]) for _, t, l, s in rows]
    held, out = defaultdict(Counter), []
    for lang, _, w in words:
        held[lang].update(set(w))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in held.items()}
    counts = defaultdict(Counter)
    for lang, source, w in words:
        counts[lang, source].update(t for t in w if t in kept[lang])
        counts[lang].update(t for t in w if t in kept[lang])

    def share(group, lang, term):
        v, n = len(kept[lang]), sum(counts[group].values())
        return 1 + Fraction(10**9 * (counts[group][term] + 5), n + 5 * v).__floor__()

    for lang, source in {x[:2] for x in words}:
        group = (lang, source)
        others = [g for g in {x[:2] for x in words} if g[0] == lang and g[1] != source]
        pairs = [(sum(abs(share(group, lang, t) - share(g, lang, t)) for t in kept[lang]), g[1]) for g in others]
        terms = [(share(group, lang, t) - share(lang, lang, t), t) for t in kept[lang] if counts[group][t]]
        for part, items, last in (("pair", pairs, None), ("term", [x for x in terms if x[0] > 0], ranks)):
            items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:last]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(items)]
    return Counter(out)


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    word = ""
    for c in lower + " ":
        if "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            yield word
            word = ""


def mixed_sources():
    draw = random.Random(3)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["É", "é", "日本", "ALPHA", "alpha"]
    rows = []
    for i in range(240):
        source, lang = draw.choice(["a", "a", "a", "b", "Ç", "c", None, ""]), draw.choice(["en", "en", "de", "d\x00e", None])
        shift = ord((source or "z")[0]) % 20
        rows.append((i, draw.choice([" ", "1", "-", "\n", "\x7f"]).join(draw.choices(vocabulary[shift:], k=draw.randrange(40))), lang, source))
    return rows + [(1, None, "xx", "only"), (1, "", "xx", "other"), (2, "12 \x00 ,", "yy", "q"), (3, "long " * 30_000, "en", "a")]


@pytest.mark.parametrize(("least", "ranks"), [(1, 50), (4, 3), (30, 50), (10_000, 50)])
def test_divergence(spark, monkeypatch, least, ranks):
    if least == 4:  # sums are passed on many times
        monkeypatch.setattr(divergence, "HELD", 64)
        monkeypatch.setattr(divergence, "PIECE", 7)
    rows = mixed_sources()
    got = divergence.source_divergence(docs(spark, rows), least, ranks)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, got.collect())) == expected_divergence(rows, least, ranks)


def test_vectors_are_those_of_the_fitted_model(spark):
    from pyspark.ml.feature import CountVectorizerModel

    frame = docs(spark, mixed_sources()).coalesce(2)
    vocabulary = divergence.fit_vocabulary(frame, 4)
    model = CountVectorizerModel.from_vocabulary([w or "<none>" for w in vocabulary], "terms", "vector")
    want = [r.vector for r in model.transform(divergence.document_terms(frame)).collect()]
    got = divergence.document_vectors(frame, vocabulary).collect()
    assert [dict(zip(r.indices, r.counts, strict=True)) for r in got] == [dict(zip(v.indices.tolist(), v.values.tolist(), strict=True)) for v in want]


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(docs(spark, [])).count() == 0


def test_shares_beyond_a_long(spark):
    df = spark.createDataFrame([(2**62, 2**63 - 1, 2**31)], "c long, n long, v long")
    got = df.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (2**62 + 5) // (2**63 - 1 + 5 * 2**31)


# whitening

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def embeddings(spark, vectors, kind="float"):
    df = spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({n: F.lit("clash") for n in ("key", "x", "v", "d", "n", "component", "whitened", "label")})


def check_whitening(rows, vectors, kept_rows, tolerance=1e-9):
    """Rows against numpy over exact whole numbers."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for _, v in kept_rows]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(Fraction(int(n * c - s), n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    found = defaultdict(dict)
    for r in rows:
        found[r.vec_id, r.deviation][r.component] = r
    components = sorted({r.component for r in rows})
    assert components == list(range(1, len(components) + 1)) and len(components) == min(16, int((values > 1e-9 * values[0]).sum()))
    expected = Counter()
    for (key, _), v in zip(kept_rows, x, strict=True):
        expected[key, sum((n * c - int(s)) ** 2 for c, s in zip(v, sums, strict=True))] += len(components)
    assert Counter((r.vec_id, r.deviation) for r in rows) == expected
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4
    for k in components:
        (explained,) = {r.explained for r in rows if r.component == k}
        assert explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-9)
        pairs = [(found[key, sum((n * c - int(s)) ** 2 for c, s in zip(v, sums, strict=True))][k].whitened,
                  float(np.array([float(Fraction(int(n * c - s), n)) for c, s in zip(v, sums, strict=True)]) @ directions[:, k - 1] / np.sqrt(values[k - 1])))
                 for (key, _), v in zip(kept_rows, x, strict=True)]
        sign = np.sign(sum(a * b for a, b in pairs))
        assert max(abs(a - sign * b) for a, b in pairs) < tolerance


def spread(n, d, seed=1):
    draw = np.random.default_rng(seed)
    return (draw.standard_normal((n, d)) * 2.0 ** -np.arange(d) * 50 + draw.standard_normal(d)).tolist()


def test_whitening(spark):
    good = [(2**60 + i, v) for i, v in enumerate(spread(300, 20))]
    good += [(None, good[0][1]), (5, good[1][1]), (5, good[1][1])]
    bad = [(1, None), (2, []), (3, [None] * 20), (4, [float("nan")] + [0.0] * 19), (6, [float("inf")] + [0.0] * 19), (7, [1e30] * 20), (8, [0.5] * 19)]
    rows = whitening.whitened_components(embeddings(spark, good + bad, "double").repartition(5)).collect()
    check_whitening(rows, None, good)


def test_whitening_of_dependent_and_constant_dimensions(spark):
    pairs = [[float(np.floor(64 * c) / 64) for c in v] for v in spread(80, 2)]
    good = [(i, [a, b, a, 2.0, a + b]) for i, (a, b) in enumerate(pairs)]
    rows = whitening.whitened_components(embeddings(spark, good, "double")).collect()
    assert {r.component for r in rows} == {1, 2}
    check_whitening(rows, None, good)


@pytest.mark.parametrize("vectors", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_whitening_without_variance(spark, vectors):
    got = whitening.whitened_components(embeddings(spark, vectors))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_deviations_that_fit_no_long():
    model = whitening.Whitening(10**9, (10**15, 0), np.zeros((2, 1)), np.ones(1), 1.0)
    x = np.array([[10**6 + 2, 1], [10**6 + 10**7, 0]], np.int64)
    assert model.deviations(x) == [5 * 10**18, None]
