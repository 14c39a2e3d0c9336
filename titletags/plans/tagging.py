"""Fit, score and evaluate a word tagger with MLlib.

A word's prediction depends on nothing but the word and its neighbours, so the
words of a corpus are counted per distinct (context, label) before anything is
fitted or evaluated: one shuffle with map-side counts turns the corpus into
weighted examples. A context that fills a third of the corpus is one example.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.functions import arrays
from titletags.functions.features import CONTEXT, context_features
from titletags.functions.labels import N_LABELS
from titletags.operators import metrics
from titletags.operators.ordered import join_on
from titletags.sources.tables import materialise

# Features are hashed to so many places, which bounds the model at 70 x WIDTH coefficients.
WIDTH = 1 << 14


def count_examples(words: DataFrame, keys: Sequence[str] = (), label: str = "label_id") -> DataFrame:
    """Distinct (keys, context, label) of labelled words in context, with their count."""
    return (
        words.filter(F.col(label).isNotNull())
        .groupBy(*keys, *CONTEXT, F.col(label).alias("label_id"))
        .agg(F.count("*").alias("n"))
    )


def with_features(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every feature of the context, as the number of its place."""
    terms = context_features(*[F.col(c) for c in CONTEXT])
    places = F.transform(terms, lambda t: F.pmod(F.hash(t), F.lit(width)).cast("string"))
    return rows.withColumn("terms", places)


def fit_tagger(examples: DataFrame, weight: str = "n", max_iter: int = 20,
               reg: float = 1e-5) -> PipelineModel:
    """Multinomial regression over all 70 labels, also those the examples lack.

    All features reach the model; beyond WIDTH of them some share a place. The places
    seen make up the vector, so that the coefficients fill their matrix and are stored
    densely: scoring with a sparse matrix is many times slower.
    """
    nominal = {"ml_attr": {"type": "nominal", "num_vals": N_LABELS}}
    rows = with_features(examples).select(
        "terms",
        F.col("label_id").cast("double").alias("label", metadata=nominal),
        F.col(weight).cast("double").alias("weight"),
    )
    vectors = CountVectorizer(
        inputCol="terms", outputCol="features", vocabSize=WIDTH, binary=True
    )
    regression = LogisticRegression(
        family="multinomial", weightCol="weight", maxIter=max_iter, regParam=reg
    )
    return Pipeline(stages=[vectors, regression]).fit(rows)


def score(words: DataFrame, model: PipelineModel, out: str = "label_id") -> DataFrame:
    """Best label per word in context; a narrow job, no shuffle."""
    vectors, regression = model.stages
    label_only = {regression.probabilityCol: "", regression.rawPredictionCol: ""}
    scored = regression.transform(vectors.transform(with_features(words)), label_only)
    return _once(scored, words.columns, F.col("prediction").cast("int"), out)


def _once(rows: DataFrame, columns: Sequence[str], value: Column, out: str) -> DataFrame:
    """Select `columns` and `value`, with the value computed once per row.

    A filter or join on a plain computed column would be pushed below it and score
    every word again; it cannot pass the array that is unfolded here.
    """
    return rows.select(*columns, F.explode(F.array(value)).alias(out))


def score_ensemble(words: DataFrame, models: Sequence[PipelineModel],
                   out: str = "label_id") -> DataFrame:
    """Label with the highest mean probability over all models.

    All models see the row in the same pass, so their vectors never leave it.
    """
    rows = with_features(words)
    probabilities = []
    for i, model in enumerate(models):
        vectors, regression = model.stages
        rows = vectors.transform(rows, {vectors.outputCol: f"_f{i}"})
        probability_only = {
            regression.featuresCol: f"_f{i}",
            regression.probabilityCol: f"_p{i}",
            regression.rawPredictionCol: "",
            regression.predictionCol: "",
        }
        rows = regression.transform(rows, probability_only)
        probabilities.append(vector_to_array(f"_p{i}"))
    return _once(rows, words.columns, arrays.argmax(arrays.mean(probabilities)), out)


def label_contexts(words: DataFrame, models: Sequence[PipelineModel],
                   out: str = "label_id") -> DataFrame:
    """The distinct contexts of words with their label, written out."""
    contexts = words.select(*CONTEXT).distinct()
    return materialise(score(contexts, models[0], out) if len(models) == 1
                       else score_ensemble(contexts, models, out))


def score_contexts(words: DataFrame, models: Sequence[PipelineModel],
                   out: str = "label_id") -> DataFrame:
    """Label of each word by one model or the mean of several, each distinct context scored once.

    `words` is read twice. The labels of the contexts are written out, so that their measured
    size decides whether they are broadcast.
    """
    return join_on(words, label_contexts(words, models, out), CONTEXT)


def evaluate(examples: DataFrame, model: PipelineModel) -> DataFrame:
    """Class report of a model on weighted examples; each context is scored once."""
    scored = score(examples, model, out="p")
    return metrics.class_report(
        metrics.confusion(scored, y="label_id", p="p", weight=F.col("n"))
    )


def aspect_f1(examples: DataFrame, model: PipelineModel) -> float:
    return metrics.f1_aspects(evaluate(examples, model)).first()["f1"] or 0.0


def overall_f1(examples: DataFrame, model: PipelineModel) -> float:
    return metrics.f1_weighted(evaluate(examples, model)).first()["f1"] or 0.0
