"""Classification scores, all derived from one confusion table.

The confusion table has one row per (truth, prediction) pair, at most 70 x 70 per
group, and is built with map-side partial counts: the word table is scanned once
and never shuffled as such.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletags.functions.labels import FIRST_ASPECT_ID
from titletags.operators.ordered import PRECEDING

# Fixed value: label id of positions that carry no label.
IGNORE_ID = -100


def labelled(df: DataFrame, label: str = "y") -> DataFrame:
    """Drop positions without a label, written as NULL or as the ignore id."""
    return df.filter(F.col(label).isNotNull() & (F.col(label) != IGNORE_ID))


def pair_predictions(truth: DataFrame, predicted: DataFrame,
                     on: Sequence[str] = ("record_number", "pos")) -> DataFrame:
    """Truth and prediction of the same position side by side."""
    return truth.join(predicted, list(on))


def prediction_check(truth: DataFrame, predicted: DataFrame, record: str = "record_number",
                     pos: str = "pos") -> DataFrame:
    """Positions of each record in the truth and in the predictions, how many of them have
    no counterpart, and a verdict."""
    left = truth.select(record, pos, F.lit(1).alias("_t"))
    right = predicted.select(record, pos, F.lit(1).alias("_p"))
    unpaired = F.col("_t").isNull() | F.col("_p").isNull()
    counts = (
        left.join(right, [record, pos], "full_outer").groupBy(record)
        .agg(F.count("_t").alias("n_truth"), F.count("_p").alias("n_predicted"),
             F.count(F.when(unpaired, 1)).alias("n_unpaired"),
             F.count(F.when(F.col("_p").isNull(), 1)).alias("_missing"))
    )
    return counts.select(
        record, "n_truth", "n_predicted", "n_unpaired",
        F.when(F.col("_missing") > 0, "positions without a prediction")
        .when(F.col("n_unpaired") > 0, "predictions left over").alias("problem"),
    )


def confusion(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = (),
              weight: Column | None = None) -> DataFrame:
    n = F.count("*") if weight is None else F.sum(weight)
    return (
        df.groupBy(*keys, F.col(y).alias("y"), F.col(p).alias("p"))
        .agg(n.cast("long").alias("n"))
    )


def class_report(conf: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, predicted, true positives, precision, recall and F1 per label."""
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("label_id"), F.col("n").alias("support"),
                 zero.alias("predicted"), zero.alias("tp")),
        F.struct(F.col("p").alias("label_id"), zero.alias("support"),
                 F.col("n").alias("predicted"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("tp")),
    )
    counts = (
        conf.select(*keys, F.inline(sides))
        .groupBy(*keys, "label_id")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    )
    return (
        counts.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def _weighted() -> Column:
    return F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support"))


def _grouped(report: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    return report.groupBy(*keys).agg(value.alias(out))


def f1_weighted(report: DataFrame, keys: Sequence[str] = (), out: str = "f1") -> DataFrame:
    """Mean F1 over all labels, weighted by support."""
    return _grouped(report, keys, _weighted(), out)


def f1_macro(report: DataFrame, keys: Sequence[str] = (), out: str = "f1") -> DataFrame:
    return _grouped(report, keys, F.avg("f1"), out)


def f1_micro(report: DataFrame, keys: Sequence[str] = (), out: str = "f1") -> DataFrame:
    return _grouped(report, keys, F.try_divide(F.sum("tp"), F.sum("support")), out)


def f1_aspects(report: DataFrame, keys: Sequence[str] = (), out: str = "f1") -> DataFrame:
    """Weighted F1 over aspect labels only.

    Words that are no aspect but predicted as one still count as false positives
    of that aspect; labels without support have weight 0. NULL if no aspect has any.
    """
    return _grouped(report.filter(F.col("label_id") >= FIRST_ASPECT_ID), keys, _weighted(), out)


def class_weights(df: DataFrame, y: str = "y", first_label: int = FIRST_ASPECT_ID) -> DataFrame:
    """Support and share of each label from `first_label` on."""
    counts = (
        df.filter(F.col(y) >= first_label)
        .groupBy(F.col(y).alias("label_id"))
        .agg(F.count("*").alias("support"))
    )
    total = F.sum("support").over(Window.partitionBy())  # one row per label by now
    return counts.withColumn("weight", F.col("support") / total)


def best_so_far(scores: DataFrame, keys: Sequence[str] = ("fold",), step: str = "epoch",
                score: str = "f1", out: str = "is_best") -> DataFrame:
    """Mark the steps whose score is strictly above every earlier one (and above 0)."""
    earlier = Window.partitionBy(*keys).orderBy(step).rowsBetween(*PRECEDING)
    best = F.coalesce(F.max(score).over(earlier), F.lit(0.0))
    return scores.withColumn(out, F.col(score) > best)


def best_step(scores: DataFrame, keys: Sequence[str] = ("fold",), step: str = "epoch",
              score: str = "f1") -> DataFrame:
    """The step whose model is kept: the highest score, the earliest step on ties."""
    # max_by keeps any of several equal scores, so the step takes part in the order
    ranked = F.struct(F.col(score), -F.col(step))
    return scores.groupBy(*keys).agg(
        F.max_by(step, ranked).alias(step), F.max(score).alias(score)
    )
