"""Stratified folds with a quota per fold and label, dealt by label sets.

Records with the same set of labels are one class. Each fold gets its whole share of every
class, which spreads the labels and all their combinations, so only the rest of a class,
fewer than k records, has to be placed. The rests are dealt class by class, those with the
rarest label first, to the folds that lack most of the class's labels (the idea of
iterative stratification, Sechidis et al. 2011, over sets instead of records). Then single
records of a rest change folds for as long as that brings the labels nearer to their quotas.

All of this reads the histogram of label sets, never the records. Spark ranks the records
of each class at random, and the ranks say which records make up a share.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.functions.text import shuffle_key
from titletags.operators import folds
from titletags.operators.ordered import digest_chunk, number_rows
from titletags.sources.tables import materialise

# Label sets that are a class of their own, the most frequent ones; records of the others
# are classes by their rarest label, so the driver holds this many sets whatever the table.
LABEL_SETS = 1 << 14
# Rounds over all pairs of folds in which records of a rest change folds, and the sets of
# either fold that a round looks at.
ROUNDS, TRIED = 60, 128


def label_sets(record_labels: DataFrame, record: str = "record_number",
               label: str = "label_id") -> DataFrame:
    """(record, labels, stratum): each record's labels in order and the rank of the rarest.
    Null labels are left out, and records with no other."""
    rarity = folds.label_rarity(record_labels, label).select(label, "rarity")
    return record_labels.join(F.broadcast(rarity), label).groupBy(record).agg(
        F.array_sort(F.collect_set(label)).alias("labels"), F.min("rarity").alias("stratum"))


def label_set_counts(sets: DataFrame) -> DataFrame:
    """(labels, stratum, n_records): the histogram of `label_sets`."""
    return sets.groupBy("labels", "stratum").agg(F.count("*").alias("n_records"))


def quota_folds(record_labels: DataFrame, k: int = 5, seed: int = folds.SEED,
                record: str = "record_number", label: str = "label_id",
                max_sets: int = LABEL_SETS) -> DataFrame:
    """Fold 0..k-1 of each record, with its stratum, the rank of its rarest label.

    Each of the `max_sets` most frequent label sets has n // k or n // k + 1 of its n
    records in every fold. Records of other sets are dealt by their rarest label, before
    the rests, which make good what that puts out of balance. Give a written table of
    `record_labels`. An empty table gives an empty one.
    """
    spark = record_labels.sparkSession
    sets = materialise(label_sets(record_labels, record, label))
    frequent = (
        label_set_counts(sets).orderBy(F.desc("n_records"), "labels").limit(max_sets).collect())
    label_type = sets.schema["labels"].dataType.simpleString()
    classes = spark.createDataFrame(
        [(row["labels"], i) for i, row in enumerate(frequent)],
        f"labels {label_type}, class int")
    # Classes below 0 are those of the rarest label.
    keyed = materialise(
        sets.join(F.broadcast(classes), "labels", "left")
        .withColumn("class", F.coalesce("class", -1 - F.col("stratum")))
    ).withColumn("_digest", shuffle_key(seed, F.col(record)))
    ranked = number_rows(
        keyed, ["_digest", record], digest_chunk(F.col("_digest"), keyed), keys=["class"],
        out="rank")

    names = [row[label] for row in record_labels.filter(F.col(label).isNotNull())
             .select(label).distinct().orderBy(label).collect()]
    place = {name: i for i, name in enumerate(names)}
    lacking = Lacking(k, len(names))
    pooled = {row["class"]: row["count"] for row in
              keyed.filter("class < 0").groupBy("class").count().collect()}
    cuts = []
    for number, size in sorted(pooled.items()):
        shares = np.full(k, size // k)
        shares[(np.arange(size % k) - number) % k] += 1
        lacking.size += size / k - shares
        cuts.append((number, _bounds(shares)))
    if pooled:
        bounds = spark.createDataFrame(cuts, "class int, bounds array<long>")
        dealt = ranked.filter("class < 0").join(F.broadcast(bounds), "class").select(
            _fold(F.col("bounds")).alias("fold"), F.explode("labels").alias("label"))
        for row in dealt.groupBy("label", "fold").count().collect():
            at = place[row["label"]]
            lacking.labels[:, at] += row["count"] / k
            lacking.labels[row["fold"], at] -= row["count"]

    found = [(row["n_records"], [place[x] for x in row["labels"]], row["stratum"])
             for row in frequent]
    for number, shares in enumerate(deal_sets(found, lacking)):
        cuts.append((number, _bounds(shares)))
    bounds = spark.createDataFrame(cuts, "class int, bounds array<long>")
    return ranked.join(F.broadcast(bounds), "class").select(
        record, "stratum", _fold(F.col("bounds")).alias("fold"))


class Lacking:
    """What each fold lacks: records in all and per label."""

    def __init__(self, k: int, n_labels: int):
        self.size = np.zeros(k)
        self.labels = np.zeros((k, n_labels))

    def of(self, labels: Sequence[int]) -> np.ndarray:
        return self.labels[:, labels].sum(axis=1) + self.size

    def give(self, fold: int | np.ndarray, labels: Sequence[int], n: float) -> None:
        self.size[fold] -= n
        self.labels[np.ix_(np.atleast_1d(fold), labels)] -= n


def deal_sets(sets: Sequence[tuple[int, Sequence[int], int]], lacking: Lacking
              ) -> list[np.ndarray]:
    """Records per fold of each set (records, labels, rank of the rarest label)."""
    k = len(lacking.size)
    shares = [np.full(k, n // k) for n, _, _ in sets]
    every = np.arange(k)
    open_sets = sorted((i for i, (n, _, _) in enumerate(sets) if n % k),
                       key=lambda i: (sets[i][2], -len(sets[i][1]), i))
    extra = {}
    for i in open_sets:
        n, labels, _ = sets[i]
        rest = n % k
        lacking.give(every, labels, -rest / k)
        extra[i] = np.argsort(-lacking.of(labels), kind="stable")[:rest]
        lacking.give(extra[i], labels, 1)
    _improve(sets, open_sets, extra, lacking)
    for i, has in extra.items():
        shares[i][has] += 1
    return shares


def _improve(sets: Sequence[tuple[int, Sequence[int], int]], open_sets: Sequence[int],
             extra: dict[int, np.ndarray], lacking: Lacking) -> None:
    """Move a record of one set to another fold, or swap it for a record of another set,
    while the sum of squares of what is lacking falls. Folds differ by one record of a set
    before and after."""
    if not open_sets:
        return
    k, n_labels = lacking.labels.shape
    has = np.zeros((len(open_sets), k), bool)
    # One row per set, its labels and a last place for the record itself; the row after all
    # sets is no record, so that a swap with it is a move.
    member = np.zeros((len(open_sets) + 1, n_labels + 1), np.int8)
    for row, i in enumerate(open_sets):
        has[row, extra[i]] = True
        member[row, [*sets[i][1], n_labels]] = 1
    lack = np.column_stack([lacking.labels, lacking.size])
    rng = np.random.default_rng(0)

    def some(rows: np.ndarray) -> np.ndarray:
        few = rng.choice(rows, TRIED, replace=False) if len(rows) > TRIED else rows
        return np.append(few, len(open_sets))

    for _ in range(ROUNDS):
        moved = False
        for f in range(k):
            for g in range(f):
                ours = some(np.flatnonzero(has[:, f] & ~has[:, g]))
                theirs = some(np.flatnonzero(has[:, g] & ~has[:, f]))
                goes = member[ours][:, None] - member[theirs][None]
                change = goes @ (lack[f] - lack[g]) + (goes != 0).sum(axis=2)
                i, j = np.unravel_index(np.argmin(change), change.shape)
                if change[i, j] < -1e-9:
                    lack[f] += goes[i, j]
                    lack[g] -= goes[i, j]
                    for row, source, target in ((ours[i], f, g), (theirs[j], g, f)):
                        if row < len(open_sets):
                            has[row, source], has[row, target] = False, True
                    moved = True
        if not moved:
            break
    for row, i in enumerate(open_sets):
        extra[i] = np.flatnonzero(has[row])
    lacking.labels, lacking.size = lack[:, :-1], lack[:, -1]


def _fold(bounds: Column) -> Column:
    """Number of inner bounds at or below the rank."""
    return F.size(F.filter(bounds, lambda b: b <= F.col("rank")))


def _bounds(shares: np.ndarray) -> list[int]:
    """Rank at which each fold but the first begins."""
    return [int(x) for x in np.cumsum(shares)[:-1]]
