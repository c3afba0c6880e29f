"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Random cosines of the standardised statistics approximate a Gaussian kernel, so a linear model on them is a kernel model
whose size does not depend on the data. Each partition of the labelled sample sums its part of the normal equations; the
sums are added and solved once. The raw scores are calibrated on rows that were not fitted on, by the best monotone step
function, and read off it by linear interpolation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.columns import id_back, id_text
from rillflow.llm.samples import fold, labelled_texts
from rillflow.llm.tokens import Words, batches
from rillflow.plans.workspace import discard, materialize

#: Labelled rows that the model is fitted on, at most; partitions that sum the normal equations.
SAMPLE, PARTITIONS = 40_000, 8
FEATURES, RIDGE, WIDTH = 256, 1e-2, 3.0
FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3

#: Characters that are counted apart.
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "bar": b"|", "bang": b"!?", "symbol": b"#$%&*@^~<>{}[]\\", "stop": b".,;:", "line": b"\n"}


def statistics(texts: list[str | None]) -> np.ndarray:
    """(texts, statistics): lengths, shares of characters and of repeated words; an empty text has zeros."""
    words = Words(texts)
    data = np.frombuffer(words.raw, np.uint8)
    size = np.maximum(np.diff(words.text_at) - 1, 0).astype(float)
    count = words.counts().astype(float)
    columns = [np.log1p(size), np.log1p(count), size / np.maximum(count, 1)]
    for characters in _CLASSES.values():
        table = np.zeros(256, np.int64)
        table[np.frombuffer(characters, np.uint8)] = 1
        sums = np.concatenate([[0], np.cumsum(table[data])])
        columns.append((sums[words.text_at[1:] - 1] - sums[words.text_at[:-1]]) / np.maximum(size, 1))
    hashes = words.hashes()
    for back in (1, 2):
        same = np.zeros(len(hashes) + 1, np.int64)
        if len(hashes) > back:
            same[back + 1 :] = np.cumsum(hashes[back:] == hashes[:-back])
        first = np.minimum(words.offsets[:-1] + back, words.offsets[1:])
        columns.append((same[words.offsets[1:]] - same[first]) / np.maximum(count, 1))
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True)], float)
    columns.append(distinct / np.maximum(count, 1))
    upper = np.isin(data[words.start], np.frombuffer(_CLASSES["upper"], np.uint8)) if len(words) else np.zeros(0, bool)
    sums = np.concatenate([[0], np.cumsum(upper)])
    columns.append((sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / np.maximum(count, 1))
    short = np.concatenate([[0], np.cumsum((words.end - words.start) <= 1)])
    columns.append((short[words.offsets[1:]] - short[words.offsets[:-1]]) / np.maximum(count, 1))
    return np.stack(columns, axis=1)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the ascending share of label 1 there, by pooling adjacent violators; equal scores are one point."""
    values, where = np.unique(score, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, label) / weight
    blocks: list[list[float]] = []  # mean, weight, sum of weighted scores
    for v, m, w in zip(values, mean, weight, strict=True):
        blocks.append([m, w, v * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, s2 = blocks.pop()
            m1, w1, s1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, s1 + s2])
    return np.array([s / w for _, w, s in blocks]), np.array([m for m, _, _ in blocks])


@dataclass
class QualityModel:
    """What executors need to score a text: some thousand numbers."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        cosines = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.clip(np.interp(self.raw(statistics(texts)), *self.steps), 0, 1)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> QualityModel:
    """Fit on at most ``rows`` labelled rows outside the held-out fold; without any, everything scores one half."""
    train = F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False))
    sample = labelled_texts(docs, labels, "quality", train, rows)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "x": list(statistics(frame["text"].tolist()))})

    measured = sample.mapInPandas(measure, "doc_id long, label int, x array<double>")
    measured = materialize(measured.withColumn("fold", fold(F.col("doc_id"), FOLDS)).repartition(PARTITIONS, "doc_id"), "quality-sample")
    n = len(statistics([""])[0])
    moments = measured.select(F.count("*"), *[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(n)]).first()
    random = np.random.default_rng(6)
    model = QualityModel(np.zeros(n), np.ones(n), random.normal(size=(n, FEATURES)) / WIDTH, random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(1), np.full(1, 0.5)))
    if not moments[0]:
        return model
    model.mean, model.scale = np.array(moments[1 : n + 1]), np.maximum(np.array(moments[n + 1 :]), 1e-6)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, moment = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for frame in frames:
            if len(frame):
                z = model.features(np.stack(frame["x"].to_numpy()))
                gram += z.T @ z
                moment += z.T @ frame["label"].to_numpy(float)
        yield pd.DataFrame({"row": np.arange(FEATURES + 1), "gram": list(gram), "moment": moment})

    fitted = measured.where(f"fold <> {CALIBRATION}")
    # one row of the equations per feature and partition, PARTITIONS x 257 in all
    sums = fitted.mapInPandas(partial, "row int, gram array<double>, moment double").toPandas().groupby("row")
    gram = np.stack(sums["gram"].apply(lambda g: np.sum(np.stack(g.to_numpy()), axis=0)).to_numpy())
    moment = sums["moment"].sum().to_numpy()
    model.beta = np.linalg.solve(gram + RIDGE * np.eye(FEATURES + 1), moment)

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"raw": model.raw(np.stack(frame["x"].to_numpy())), "label": frame["label"]})

    rated = measured.where(f"fold = {CALIBRATION}").mapInPandas(rate, "raw double, label int").toPandas()  # of the bounded sample
    discard(measured)
    if len(rated):
        model.steps = isotonic(rated["raw"].to_numpy(), rated["label"].to_numpy(float))
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def quality_scores(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score of 0.7 or more).

    ``score`` is the calibrated probability of good quality of the whole text; nothing but the text enters it. An empty
    or null text has statistics of zero and a score like any other. Rows that repeat get the same score each. A null id
    counts as held out. Other columns are not read.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.scores(frame["text"].tolist())})

    scored = id_back(docs.select(id_text(), "text").mapInPandas(work, "doc_id string, score double"))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
