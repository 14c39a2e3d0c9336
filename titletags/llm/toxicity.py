"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each is a sparse logistic regression on
the words of the text (and on the first letters of long words), and on the probabilities
of the categories before it, as log-odds, which no absolute penalty keeps at zero. While it
is trained, these come from models that have not seen the document (out-of-fold), as they
will when it is used. Every fold has its share of either label, so that what a model lacks
does not tell the labels of the documents it has not seen.

Scale: nothing is shuffled but the labels. The chain is fitted on a bounded sample of
labelled documents; each document is scored where it is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.llm.linear import Row, ftrl
from titletags.llm.samples import labelled_sample

# Bound of the fit in labelled documents.
SAMPLE_ROWS = 6_000
BUCKETS = 1 << 18
FOLDS = 3
STEM_BYTES = 5
PENALTIES = {"alpha": 0.3, "l1": 5.0, "l2": 0.01, "epochs": 3}
# Log-odds are taken no further out than this probability, in units of the size of a feature.
CERTAIN = 1e-3
ODDS_UNIT = 4.0
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&-"


def word_features(text: str | None) -> np.ndarray:
    """Buckets of the distinct words of a text and of their stems, in order."""
    words = {w.strip(_EDGES) for w in set((text or "").lower().encode().split())}
    stems = {w[:STEM_BYTES] for w in words if len(w) > STEM_BYTES}
    found = [zlib.crc32(w) % BUCKETS for w in words]
    found += [zlib.crc32(w, 1) % BUCKETS for w in stems]
    return np.unique(np.array(found, np.int64))


def _extended(at: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word features and the log-odds of the earlier categories."""
    places = np.append(at, BUCKETS + np.arange(len(earlier)))
    sure = np.clip(earlier, CERTAIN, 1 - CERTAIN)
    return places, np.append(np.ones(len(at)), np.log(sure / (1 - sure)) / ODDS_UNIT)


def label_folds(label: np.ndarray, folds: int) -> np.ndarray:
    """Fold of each row, the rows of either label dealt out in turn."""
    out = np.zeros(len(label), np.int64)
    for value in (0, 1):
        own = np.flatnonzero(label == value)
        out[own] = np.arange(len(own)) % folds
    return out


@dataclass(frozen=True)
class ToxicityChain:
    categories: list[str]
    weights: list[np.ndarray]  # one weight per feature, the last is the constant
    thresholds: list[float]

    def probabilities(self, at: np.ndarray) -> np.ndarray:
        earlier = np.zeros(0)
        for weights in self.weights:
            earlier = np.append(earlier, _probability(weights, *_extended(at, earlier)))
        return earlier


def _probability(weights: np.ndarray, at: np.ndarray, values: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[at] @ values + weights[-1], -500, 500))))


def _binary(rows: list[Row], n_features: int) -> np.ndarray:
    weights = ftrl(rows, n_features, 2, free_from=BUCKETS, **PENALTIES)
    return weights[:, 1] - weights[:, 0]


def best_threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The cut with the highest F1, in the middle between two scores."""
    if not truth.any():
        return 1.0
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(truth) + 1) + truth.sum())
    f1[:-1][scores[order][:-1] == scores[order][1:]] = -1  # no cut between equal scores
    best = int(f1.argmax())
    below = scores[order][best + 1] if best + 1 < len(scores) else 0.0
    return float((scores[order][best] + below) / 2)


def fit_chain(features: list[np.ndarray], truth: np.ndarray, categories: list[str],
              folds: int = FOLDS) -> ToxicityChain:
    """Learn a chain; `truth` has a column per category in the order of the chain."""
    n = len(features)
    earlier = np.zeros((n, 0))
    weights, thresholds = [], []
    for k in range(len(categories)):
        label = truth[:, k].astype(int)
        rows = [(*_extended(at, earlier[i]), int(label[i])) for i, at in enumerate(features)]
        width = BUCKETS + k
        unseen, fold_of = np.zeros(n), label_folds(label, folds)
        for fold in range(folds):
            model = _binary([rows[i] for i in np.flatnonzero(fold_of != fold)], width)
            for i in np.flatnonzero(fold_of == fold):
                unseen[i] = _probability(model, *rows[i][:2])
        weights.append(_binary(rows, width))
        thresholds.append(best_threshold(unseen, label))
        earlier = np.column_stack([earlier, unseen])
    return ToxicityChain(categories, weights, thresholds)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], doc_id: str = "doc_id",
        text: str = "text", max_rows: int = SAMPLE_ROWS) -> ToxicityChain:
    """Learn from at most `max_rows` labelled documents. `categories` are 0/1 columns of
    `labels`, in the order of the chain."""

    def featured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([word_features(t).astype(np.int32).tobytes() for t in texts],
                            dtype="object")

    found = F.pandas_udf(featured, "binary")
    sample = labelled_sample(docs, labels, categories, max_rows, doc_id, text).select(
        "doc_id", *categories, found("text").alias("_at")).collect()
    sample.sort(key=lambda r: (r["doc_id"], *(r[c] for c in categories), bytes(r["_at"])))
    truth = np.array([[r[c] >= 1 for c in categories] for r in sample]).reshape(-1, len(categories))
    return fit_chain([np.frombuffer(r["_at"], np.int32).astype(np.int64) for r in sample],
                     truth, categories)


def probabilities(chain: ToxicityChain, spark, text: Column) -> Column:
    """Array of the probabilities of the categories."""
    shared = spark.sparkContext.broadcast(chain)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.probabilities(word_features(t)) for t in texts],
                            dtype="object")

    return F.pandas_udf(scored, "array<double>")(text)


def score_toxicity(docs: DataFrame, chain: ToxicityChain, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Per row: doc_id, and for each category p_<category> and is_<category> (1 from the
    threshold with the best F1 on unseen documents on).

    Null, empty and blank texts have no words and get what the constants give. Repeated
    rows and null ids each get their row; without labels, or without a single positive
    one, no document is positive. An empty table gives an empty table. Other columns are
    not read.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"),
                         probabilities(chain, docs.sparkSession, F.col(text)).alias("_p"))
    out = []
    for k, (name, cut) in enumerate(zip(chain.categories, chain.thresholds)):
        out += [F.col("_p")[k].alias(f"p_{name}"),
                (F.col("_p")[k] >= cut).cast("int").alias(f"is_{name}")]
    return scored.select("doc_id", *out)
