"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Lexicon voters are words and word beginnings that labelled toxic texts hold far more often than clean ones, pattern
voters look at how a text is written: shouted, with repeated marks, with masked words, at somebody, full of such words.
A voter that fires votes for toxic (the pattern voter of an unsuspicious text for clean) and
abstains otherwise. The label model estimates how often each voter is right, with the given label as one more voter that
can be wrong, by expectation and maximisation; voters that fire together beyond what the class explains share one vote
between them. A logistic regression on the voters learns the model's posterior labels and scores every whole text.
"""

from __future__ import annotations

import re
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

#: Labelled rows that voters, label model and classifier are fitted on, at most.
SAMPLE = 40_000
#: Lengths of word beginnings in bytes; None is the whole word.
PREFIXES = (4, 5, 6, 8, None)
#: Lexicon voters, at most; candidates for them.
VOTERS, CANDIDATES = 400, 20_000
FOLDS, HELD_OUT = 5, 0
#: Patterns over the text, each a voter: repeated marks, words in capitals one after the other, letters masked by signs,
#: and insults' ways to address somebody.
PATTERNS = [re.compile(p) for p in (r"[!?]{2}", r"[A-Z]{3,} [A-Z]{3}", r"[*#@$%]{2,}\w|[*]\w", r"[Yy]ou(?: are|'re| all)? (?:an?|such|so|stupid)\b")]
#: Voters besides the lexicon: two shares of lexicon words, the patterns, and none of all these, which votes for clean.
OTHERS = len(PATTERNS) + 3


def _pattern_votes(texts: list[str | None]) -> np.ndarray:
    return np.array([[p.search(t or "") is not None for p in PATTERNS] for t in texts], np.float32).reshape(len(texts), len(PATTERNS))


def _terms(words: Words) -> list[np.ndarray]:
    """The words' hashes by each of PREFIXES; 0 stands for none."""
    return [np.where(h == 0, h, h ^ np.uint64(i + 1)) for i, h in enumerate(words.hashes(p) for p in PREFIXES)]


def _hits(words: Words, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, entry) of every occurrence of an entry of the sorted lexicon."""
    text = np.repeat(np.arange(len(words.offsets) - 1), words.counts())
    texts, entries = [], []
    for h in _terms(words):
        at = np.searchsorted(lexicon, h).clip(max=len(lexicon) - 1)
        found = np.flatnonzero(lexicon[at] == h)
        texts.append(text[found])
        entries.append(at[found])
    return np.concatenate(texts), np.concatenate(entries)


def _term_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, texts) of the terms of a batch: in how many texts they are."""
    for frame in batches(frames):
        words = Words(frame["text"].tolist(), lower=True)
        text = np.repeat(np.arange(len(frame), dtype=np.uint64), words.counts())
        terms = []
        for h in _terms(words):
            order = np.lexsort((text, h))
            h, t = h[order], text[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])]) if len(h) else np.zeros(0, bool)
            terms.append(h[new & (h != 0)])
        found, count = np.unique(np.concatenate(terms), return_counts=True)
        yield pd.DataFrame({"term": found.view(np.int64), "texts": count})


def _lexicon(sample: DataFrame) -> np.ndarray:
    """Hashes, sorted, of the terms that tell toxic texts best."""
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return np.zeros(0, np.uint64)
    frequent = sample.where("label = 1").mapInPandas(_term_counts, "term long, texts long").groupBy("term").agg(F.sum("texts").alias("toxic"))
    frequent = frequent.where(F.col("toxic") >= max(3, toxic // 400)).orderBy(F.desc("toxic"), "term").limit(CANDIDATES).toPandas()
    known = np.sort(frequent["term"].to_numpy(np.int64).view(np.uint64))
    if not len(known):
        return known

    def among(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            text, entry = _hits(Words(frame["text"].tolist(), lower=True), known)
            pairs = np.unique(text * len(known) + entry)
            found, count = np.unique(pairs % len(known), return_counts=True)
            yield pd.DataFrame({"term": known[found].view(np.int64), "texts": count})

    others = sample.where("label = 0").mapInPandas(among, "term long, texts long").groupBy("term").agg(F.sum("texts").alias("clean")).toPandas()
    counts = frequent.merge(others, "left", "term").fillna(0)
    odds = np.log((counts["toxic"] + 0.5) / (toxic + 1)) - np.log((counts["clean"] + 0.5) / (clean + 1))
    counts["gain"] = counts["toxic"] * odds
    best = counts[odds > np.log(20)].sort_values(["gain", "term"], ascending=[False, True]).head(VOTERS)
    return np.sort(best["term"].to_numpy(np.int64).view(np.uint64))


def _votes(texts: list[str | None], lexicon: np.ndarray) -> np.ndarray:
    """(texts, lexicon + patterns) array of 0 and 1; the last pattern, of texts without any other vote, is for clean."""
    words = Words(texts, lower=True)
    out = np.zeros((len(texts), len(lexicon) + OTHERS), np.float32)
    first = len(lexicon)
    if len(lexicon):
        text, entry = _hits(words, lexicon)
        out[text, entry] = 1
        hit = np.zeros(len(words), bool)
        for h in _terms(words):
            hit |= lexicon[np.searchsorted(lexicon, h).clip(max=len(lexicon) - 1)] == h
        share = np.add.reduceat(np.concatenate([hit, [False]]).astype(np.float64), words.offsets[:-1]) * (words.counts() > 0)
        out[:, first] = share >= 2
        out[:, first + 1] = (share >= 0.01 * np.maximum(words.counts(), 1)) & (share > 0)
    out[:, first + 2 : -1] = _pattern_votes(texts)
    out[:, -1] = out[:, :-1].sum(axis=1) == 0
    return out


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior probability of toxic for each row, from votes and a given label that is one more voter."""
    fired = votes.sum(axis=0)
    side = np.ones(votes.shape[1])
    side[-1] = -1
    posterior = np.clip(labels.astype(float), 0.1, 0.9)
    prior = posterior.mean()
    right, trust = np.full(votes.shape[1], 0.8), 0.9
    weight = np.ones(votes.shape[1])
    for turn in range(rounds):
        agree = np.where(side > 0, votes.T @ posterior, votes.T @ (1 - posterior))
        right = np.clip((agree + 2) / (fired + 3), 0.05, 0.995)
        trust = np.clip((posterior @ labels + (1 - posterior) @ (1 - labels) + 9) / (len(labels) + 10), 0.6, 0.98)
        if turn in (2, 10):
            # what voters have in common beyond the class: correlation of the votes within it
            mean = np.outer(posterior, votes.T @ posterior / posterior.sum()) + np.outer(1 - posterior, votes.T @ (1 - posterior) / (1 - posterior).sum())
            rest = votes - mean
            sd = np.sqrt((rest**2).sum(axis=0)) + 1e-9
            together = np.clip(rest.T @ rest / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(together, 1)  # a voter that never varies goes by itself
            weight = 1 / together.sum(axis=0)
        odds = np.log(prior / (1 - prior)) + votes @ (side * weight * np.log(right / (1 - right)))
        odds = odds + (2 * labels - 1) * np.log(trust / (1 - trust))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = np.clip(posterior.mean(), 0.001, 0.999)
    return posterior


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients, the intercept last, of a logistic regression on probabilities (Newton steps)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (target - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class ToxicityModel:
    """What executors need to score a text: some hundred numbers."""

    lexicon: np.ndarray
    beta: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        odds = _votes(texts, self.lexicon) @ self.beta[:-1] + self.beta[-1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``rows`` labelled rows outside the held-out fold; without any, everything scores the same."""
    train = F.coalesce(fold(F.col("doc_id"), FOLDS) != HELD_OUT, F.lit(False))
    sample = materialize(labelled_texts(docs, labels, "toxic", train, rows), "toxicity-sample")
    lexicon = _lexicon(sample)

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            bits = np.packbits(_votes(frame["text"].tolist(), lexicon).astype(bool), axis=1)
            yield pd.DataFrame({"label": frame["label"], "votes": [b.tobytes() for b in bits]})

    # equal rows of votes are counted where they are; at most ``rows`` rows of 51 bytes come to the driver
    counted = sample.mapInPandas(vote, "label int, votes binary").groupBy("label", "votes").count().toPandas()
    discard(sample)
    if not len(counted):
        return ToxicityModel(lexicon, np.array([0.0] * (len(lexicon) + OTHERS) + [-4.0]))
    bits = np.frombuffer(b"".join(counted["votes"]), np.uint8).reshape(len(counted), -1)
    votes = np.unpackbits(bits, axis=1)[:, : len(lexicon) + OTHERS].astype(np.float64)
    times = counted["count"].to_numpy()
    order = np.lexsort([*bits.T, counted["label"].to_numpy()])
    votes, labels_, times = votes[order].repeat(times[order], 0), counted["label"].to_numpy()[order].repeat(times[order]), None
    return ToxicityModel(lexicon, logistic(votes, label_model(votes, labels_)))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    ``score`` is the probability of toxic for the whole text; nothing but the text enters it, and an empty or null one
    gets the score of a text without a vote. Rows that repeat get the same score each. A null id counts as held out.
    Other columns are not read.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.scores(frame["text"].tolist())})

    scored = id_back(docs.select(id_text(), "text").mapInPandas(work, "doc_id string, score double"))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; all columns stay as they are, and only texts leave the JVM.

    Null and empty texts stay, as a text without a vote scores less; repeated rows go or stay together.
    """

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        parts = [model.scores(part["text"].tolist()) < 0.5 for part in batches(iter([texts.to_frame("text")]))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(clean(F.col("text")))
