"""Multi-label stratified folds and their label distribution.

Labels are given as dictionary ids (0..69), so every per-label table below has at
most 70 rows and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titletags.functions.text import shuffle_key
from titletags.operators.ordered import by_keys, digest_chunk, number_rows
from titletags.sources.tables import materialise

SEED = 42


def record_label_counts(words: DataFrame, record: str = "record_number",
                        label: str = "label_id", place: Sequence[str] = ()) -> DataFrame:
    """Words per record and label: at most 70 rows for even the longest record.

    `place` names columns by which the words lie dealt out and of which no record has two
    values; they are counted where they lie then.
    """
    counts = words.groupBy(record, label, *place).agg(F.count("*").alias("n_words"))
    return counts.drop(*place)


def label_rarity(record_labels: DataFrame, label: str = "label_id") -> DataFrame:
    """Records per label, and the labels ranked from the rarest (0) on."""
    totals = record_labels.groupBy(label).agg(F.count("*").alias("n_records"))
    rank = F.row_number().over(Window.orderBy("n_records", label)) - 1  # at most 70 rows
    return totals.withColumn("rarity", rank)


def strata(record_labels: DataFrame, seed: int = SEED, record: str = "record_number",
           label: str = "label_id") -> DataFrame:
    """Each record's rarest label as `stratum` and its seeded random rank within it.

    A stratum may hold most records, so ranks are counted within (stratum, leading
    digest digits) and shifted by the counts of the digests before. The strata are written
    out once and read for their number, the counts and the ranks; give a written
    table of `record_labels` as well.
    """
    rarity = label_rarity(record_labels, label).select(label, "rarity")
    rarest = materialise(
        by_keys(record_labels, [record], record_labels.count())
        .join(F.broadcast(rarity), label)
        .groupBy(record)
        .agg(F.min("rarity").alias("stratum"))
    )
    # Worked out again behind the shuffle, which is smaller without it.
    digest = shuffle_key(seed, F.col(record))
    return number_rows(
        rarest, [digest, record], digest_chunk(digest, rarest), keys=["stratum"],
        out="rank", n_rows=rarest.count(),
    )


def assign_folds(record_labels: DataFrame, k: int = 5, seed: int = SEED,
                 record: str = "record_number", label: str = "label_id") -> DataFrame:
    """Fold 0..k-1 of each record, every stratum dealt out evenly in random order."""
    ranked = strata(record_labels, seed, record, label)
    return ranked.select(record, "stratum", (F.col("rank") % k).cast("int").alias("fold"))


def split_fold(rows: DataFrame, folds: DataFrame, fold: int, record: str = "record_number",
               n_rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold; a fold that does not exist has no test rows. Where
    the number of rows is known, it decides on the number of partitions."""
    assigned = by_keys(rows, [record], n_rows).join(folds.select(record, "fold"), record)
    return assigned.filter(F.col("fold") != fold), assigned.filter(F.col("fold") == fold)


def fold_distribution(record_labels: DataFrame, folds: DataFrame, labels: Sequence[int],
                      k: int = 5, record: str = "record_number",
                      label: str = "label_id") -> DataFrame:
    """Words per label of interest on the train and the test side of each fold.

    Counted from the per-record counts, so one very long record weighs no more
    than any other; the train side is the total less the test side.
    """
    wanted = record_labels.filter(F.col(label).isin(list(labels)))
    n_test = (
        wanted.join(folds.select(record, "fold"), record)
        .groupBy("fold", label)
        .agg(F.sum("n_words").alias("n_test"))
    )
    grid = record_labels.sparkSession.range(k).select(
        F.col("id").cast("int").alias("fold"),
        F.explode(F.array(*[F.lit(i) for i in labels])).alias(label),
    )
    filled = grid.join(n_test, ["fold", label], "left").fillna(0, ["n_test"])
    total = F.sum("n_test").over(Window.partitionBy(label))  # k rows per label
    return filled.withColumn("n_train", total - F.col("n_test"))


def fold_balance(distribution: DataFrame, label: str = "label_id") -> DataFrame:
    """Largest and smallest test share of each label, and how far from even it gets."""
    share = F.col("n_test") / (F.col("n_test") + F.col("n_train"))
    k = F.count("*")
    return (
        distribution.filter(F.col("n_test") + F.col("n_train") > 0)
        .groupBy(label)
        .agg(
            F.min("n_test").alias("min_test"),
            F.max("n_test").alias("max_test"),
            F.greatest(F.max(share) * k - 1, 1 - F.min(share) * k).alias("max_deviation"),
        )
    )
