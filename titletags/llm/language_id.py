"""Language identification by sparse multinomial logistic regression.

Features are character n-grams (one to three characters of the lower-cased text, with
everything that is no letter as a space), hashed into a fixed number of buckets and
weighted by (1 + ln count) x inverse document frequency, scaled to length one. The
frequencies cover all documents that may be learned from. The regression is trained by
follow-the-regularised-leader with elastic-net penalties, one document at a time, over
a bounded sample per language; a part of the sample that it does not learn from sets
the temperature of its probabilities.

Scale: no text is shuffled. One pass counts document frequencies into one vector per
task, one pass scores. The model is buckets x languages numbers, MAX_MODEL_BYTES at
most: beyond 255 languages neighbouring buckets are put together, so that any number of
languages can be learned, and beyond 8 the sample has fewer rows of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.llm.linear import ftrl, softmax


BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
# Bounds of the sample per language and in all (one row of each language at least), and
# the share of it kept for the temperature.
ROWS_PER_LANGUAGE = 1000
SAMPLE_ROWS = 8192
CALIBRATION_SHARE = 0.2
MAX_MODEL_BYTES = 1 << 26
CHARS_AT_ONCE = 1 << 18
UNDETERMINED = "und"

_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Number of n-grams of the whole text in each bucket."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 128, _ASCII[points & 127], points)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), CHARS_AT_ONCE):
        part = points[at:at + CHARS_AT_ONCE + ORDERS[-1] - 1]
        key = np.zeros(len(part), np.uint32)
        found = []
        for order in ORDERS:
            n = min(len(part) - order + 1, CHARS_AT_ONCE)
            if n <= 0:
                break
            key = (key[:n] + part[order - 1:order - 1 + n]) * _MIX[order - 1]
            found.append(((key ^ (key >> np.uint32(15))) * _MIX[0]) >> _SHIFT)
        counts += np.bincount(np.concatenate(found), minlength=BUCKETS)
    return counts


def put_together(counts: np.ndarray, buckets: int) -> np.ndarray:
    """Counts in fewer buckets, a power of two."""
    return counts if buckets == len(counts) else counts.reshape(buckets, -1).sum(axis=1)


def buckets_for(languages: int) -> int:
    """As many buckets, BUCKETS at most, as leave the model within MAX_MODEL_BYTES."""
    buckets = BUCKETS
    while buckets > 1 and (buckets + 1) * 8 * languages > MAX_MODEL_BYTES:
        buckets //= 2
    return buckets


def sparse_features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of one text; the values have length one."""
    counts = put_together(ngram_counts(text), len(idf))
    at = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm > 0 else values


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets + 1 (the constant) x languages
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        at, values = sparse_features(text, self.idf)
        p = softmax((values @ self.weights[at] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def inverse_document_frequencies(docs: DataFrame, text: str = "text",
                                 buckets: int = BUCKETS) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the bucket)) + 1, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequency, rows = np.zeros(buckets + 1, np.int64), 0
        for batch in batches:
            for text in batch["_text"]:
                frequency[:-1] += put_together(ngram_counts(text or ""), buckets) > 0
                rows += 1
        frequency[-1] = rows
        at = np.flatnonzero(frequency)
        yield pd.DataFrame({"bucket": at, "n": frequency[at]})

    counted = (
        docs.select(F.col(text).alias("_text")).mapInPandas(count, "bucket int, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    frequency = np.zeros(buckets + 1)
    for bucket, n in counted.collect():  # one row per bucket
        frequency[bucket] = n
    return np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1


def best_temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the lowest log loss, found on a logarithmic grid."""
    if not len(truth):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    at = np.arange(len(truth))
    losses = [-np.log(np.maximum(softmax(scores / t)[at, truth], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows that have a language and a letter; `key` only draws the sample,
    of `rows_per_language` rows each and SAMPLE_ROWS in all."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"),
        F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit(2**63 - 1)).alias("_draw"))
    sizes = {row["_lang"]: row["count"] for row in usable.groupBy("_lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    buckets = buckets_for(len(languages))
    idf = inverse_document_frequencies(usable, "_text", buckets)

    rows_each = min(rows_per_language, max(1, SAMPLE_ROWS // len(languages)))
    shares = F.create_map(*[F.lit(x) for name, n in sizes.items()
                            for x in (name, min(1.0, rows_each / n))])
    drawn = usable.filter(F.col("_draw") <= shares[F.col("_lang")] * float(2**63)).orderBy(
        "_draw").limit(rows_each * len(languages))
    number = {name: i for i, name in enumerate(languages)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sparse_features(t, idf) for t in batch["_text"]]
            yield pd.DataFrame({"lang": batch["_lang"], "draw": batch["_draw"],
                                "at": [a.astype(np.int32).tobytes() for a, _ in found],
                                "values": [v.astype(np.float32).tobytes() for _, v in found]})

    schema = "lang string, draw long, at binary, values binary"
    sample = [
        (np.frombuffer(r["at"], np.int32), np.frombuffer(r["values"], np.float32).astype(float),
         number[r["lang"]])
        for r in sorted(drawn.mapInPandas(features, schema).toLocalIterator(),
                        key=lambda r: (r["draw"], r["lang"]))
    ]
    every = max(2, round(1 / CALIBRATION_SHARE))
    learned = [row for i, row in enumerate(sample) if i % every]
    weights = ftrl(learned or sample, buckets, len(languages), alpha=1.0, l1=0.002, l2=0.01)
    kept = [row for i, row in enumerate(sample) if i % every == 0]
    scores = np.array([values @ weights[at] + weights[-1] for at, values, _ in kept])
    return LanguageModel(languages, idf, weights,
                         best_temperature(scores, np.array([label for *_, label in kept])))


def language(model: LanguageModel, spark, text: Column) -> Column:
    """Struct (lang_pred, score) of a text: `und` and 0 if it is null or has no letter."""
    shared = spark.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts],
                               columns=["lang_pred", "score"])

    return F.pandas_udf(predicted, "lang_pred string, score double")(text)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (the probability of that language).

    Null texts and texts without a letter get `und` and score 0, as does everything if
    there was nothing to learn from. Whole texts are read however long. Repeated rows
    and null ids each get their row; an empty table gives an empty table; other columns
    are not read.
    """
    said = language(model, docs.sparkSession, F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), said.alias("_said")).select(
        "doc_id", "_said.lang_pred", "_said.score")


def keep_identified(docs: DataFrame, model: LanguageModel, lowest_score: float = 0.5,
                    text: str = "text") -> DataFrame:
    """The rows of `docs` whose language is told with at least this probability, with
    all their columns."""
    said = language(model, docs.sparkSession, F.col(text))
    return (
        docs.select(F.struct("*").alias("_row"), said.alias("_said"))
        .filter((F.col("_said.lang_pred") != UNDETERMINED)
                & (F.col("_said.score") >= lowest_score))
        .select("_row.*")
    )


