"""Laws that hold for any input, and inputs with one very heavy key."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.plain import forward_fill_single
from titletags.functions.labels import N_LABELS, label_rows
from titletags.operators import batches, compare, folds, metrics
from titletags.operators import sequences as seqs
from titletags.operators.fill import forward_fill
from titletags.operators.ordered import long_records, number_rows, range_chunk
from titletags.operators.spans import decode_spans
from titletags.plans import fixtures as fx
from titletags.plans.quota_folds import Lacking, deal_sets, quota_folds

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
LABELS = [row[1] for row in label_rows()]


def spans_in_python(words):
    """Brute force over (token, label) of one record."""
    spans = []
    for token, label in words:
        if label in ("No Tag", "Obscure"):
            continue
        if label.endswith("-I") and spans:
            spans[-1][1].append(token)
        else:
            spans.append((label.removesuffix("-I"), [token]))
    return [(aspect, " ".join(tokens)) for aspect, tokens in spans]


@FEW
@given(st.lists(st.lists(st.sampled_from(LABELS), min_size=1, max_size=12), min_size=1, max_size=20))
def test_spans_equal_brute_force(spark, records):
    rows = [(r, p, f"w{p}", label) for r, ls in enumerate(records) for p, label in enumerate(ls)]
    df = spark.createDataFrame(rows, "record_number long, pos int, token string, label string")
    wanted = [(r, i + 1, *s) for r, ls in enumerate(records) for i, s in enumerate(
        spans_in_python([(f"w{p}", label) for p, label in enumerate(ls)]))]
    for long in (None, long_records(df, limit=5)):
        got = decode_spans(df, long=long).orderBy("record_number", "span_no").collect()
        assert [tuple(g) for g in got] == wanted


@pytest.fixture(scope="module")
def heavy(spark):
    """One record with a third of all words, the rest in records of five words."""
    words = spark.range(60_000).select(
        F.when(F.col("id") < 20_000, -1).otherwise(F.floor(F.col("id") / 5)).alias("record_number"),
        F.when(F.col("id") < 20_000, F.col("id")).otherwise(F.col("id") % 5).alias("pos"),
        F.concat(F.lit("w"), F.col("id") % 13).alias("token"),
        F.col("id").alias("row_idx"),
        F.element_at(F.array(*map(F.lit, LABELS)), (F.col("id") * 7 % 70 + 1).cast("int"))
        .alias("label"),
    )
    return words.cache()


def test_spans_with_a_heavy_record(spark, heavy):
    plain = decode_spans(heavy)
    split = decode_spans(heavy, long=long_records(heavy, limit=1000))
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_neighbours_with_a_heavy_record(spark, heavy):
    plain = seqs.with_neighbours(heavy)
    split = seqs.with_neighbours(heavy, long=long_records(heavy, limit=1000))
    assert plain.exceptAll(split.select(*plain.columns)).count() == 0
    assert split.count() == 60_000


def test_dense_positions_with_a_heavy_record(spark, heavy, monkeypatch):
    monkeypatch.setattr(seqs, "HOT_ROWS", 100)
    dense = seqs.dense_positions(heavy.withColumnRenamed("pos", "old"))
    assert dense.filter("pos <> old").count() == 0 and dense.count() == 60_000


@pytest.mark.parametrize("rows", [1, 97, 4096, 1 << 18])
def test_fill_does_not_depend_on_the_chunks(spark, heavy, rows):
    gaps = heavy.withColumn("tag", F.when(F.col("row_idx") % 11 == 3, F.col("label")))
    wanted = forward_fill_single(gaps, inner=True)
    got = forward_fill(gaps, inner=True, rows_per_chunk=rows)
    assert wanted.exceptAll(got).count() == 0 and got.count() == 60_000


def test_row_numbers(spark, heavy):
    shuffled = heavy.orderBy(F.md5(F.col("row_idx").cast("string")))
    numbered = number_rows(shuffled, ["row_idx"], range_chunk(F.col("row_idx"), 1000))
    assert numbered.filter("row_no <> row_idx").count() == 0


def _label_counts(spark, sf_dir):
    gold = fx.gold(spark, sf_dir).withColumnRenamed("y", "label_id")
    return folds.record_label_counts(gold).cache()


def test_folds_partition_the_records_evenly(spark, sf_dir):
    counts = _label_counts(spark, sf_dir)
    n = counts.select("record_number").distinct().count()
    for assigned in (folds.assign_folds(counts), quota_folds(counts)):
        assigned = assigned.cache()
        sizes = {r.fold: r["count"] for r in assigned.groupBy("fold").count().collect()}
        assert sum(sizes.values()) == n == assigned.select("record_number").distinct().count()
        assert set(sizes) == set(range(5))
        assert max(sizes.values()) - min(sizes.values()) <= N_LABELS
        placed = counts.join(assigned, "record_number").groupBy("label_id", "fold").count()
        spread = placed.groupBy("label_id").agg(
            F.sum("count").alias("n"), (F.max("count") - F.min("count")).alias("gap")
        )
        assert spread.filter(F.col("gap") > F.greatest(F.col("n") * 0.02, F.lit(10))).count() == 0


def test_folds_with_one_stratum(spark):
    """Every record has the same label: one stratum with all the rows."""
    counts = spark.range(10_000).select(
        F.col("id").alias("record_number"), F.lit(20).alias("label_id"), F.lit(1).alias("n_words")
    )
    sizes = [r["count"] for r in folds.assign_folds(counts, 7).groupBy("fold").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_missing_fold_has_no_test_rows(spark, heavy):
    words = heavy.withColumn("label_id", (F.col("row_idx") % 3).cast("int"))
    assigned = folds.assign_folds(folds.record_label_counts(words))
    train, test = folds.split_fold(words, assigned, 9)
    assert (train.count(), test.count()) == (60_000, 0)


@given(st.lists(st.tuples(st.integers(0, 300), st.sets(st.integers(0, 9), min_size=1)),
                max_size=30), st.integers(2, 8))
def test_shares_of_label_sets_are_even_and_add_up(sets, k):
    found = [(n, sorted(labels), min(labels)) for n, labels in sets]
    lacking = Lacking(k, 10)
    shares = deal_sets(found, lacking)
    sizes, per_label = sum(shares, np.zeros(k)), np.zeros((k, 10))
    for (n, labels, _), share in zip(found, shares, strict=True):
        assert share.sum() == n and set(share) <= {n // k, -(-n // k)}
        per_label[:, labels] += share[:, None]
    assert np.allclose(sizes.mean() - sizes, lacking.size)
    assert np.allclose(per_label.mean(axis=0) - per_label, lacking.labels)


def greedy_folds(records, k):
    """Records one after another, the label with the fewest left first, each to the fold
    that lacks most of it."""
    total = Counter(x for labels in records for x in labels)
    lacking = [{x: n / k for x, n in total.items()} for _ in range(k)]
    sizes, left = [len(records) / k] * k, set(range(len(records)))
    while left:
        remaining = Counter(x for i in left for x in records[i])
        label = min(remaining, key=lambda x: (remaining[x], x))
        for i in sorted(i for i in left if label in records[i]):
            fold = max(range(k), key=lambda f: (lacking[f][label], sizes[f], -f))
            for x in records[i]:
                lacking[fold][x] -= 1
            sizes[fold] -= 1
            left.remove(i)
    return [abs(x) for fold in lacking for x in fold.values()]


@pytest.mark.parametrize("max_sets", [8, 1 << 14])
def test_quota_folds_are_as_even_as_a_plain_greedy(spark, max_sets):
    rng = np.random.default_rng(7)
    chance = 0.6 / np.arange(1, 13)
    records = [sorted({int(x) for x in np.flatnonzero(rng.random(12) < chance)} or {0})
               for _ in range(1000)]
    counts = spark.createDataFrame(
        [(i, x) for i, labels in enumerate(records) for x in labels],
        "record_number long, label_id int")
    got = quota_folds(counts, 5, max_sets=max_sets).collect()
    assert sorted(r["record_number"] for r in got) == list(range(1000))
    total = Counter(x for labels in records for x in labels)
    placed, by_set = Counter(), Counter()
    for r in got:
        placed.update((r["fold"], x) for x in records[r["record_number"]])
        by_set[r["fold"], tuple(records[r["record_number"]])] += 1
    off = [abs(placed[f, x] - n / 5) for x, n in total.items() for f in range(5)]
    if max_sets > 8:
        assert max(off) <= max(greedy_folds(records, 5))
        assert sum(off) <= sum(greedy_folds(records, 5)) and max(off) <= 1
        for s in {s for _, s in by_set}:
            n = [by_set[f, s] for f in range(5)]
            assert max(n) - min(n) <= 1
    else:
        assert max(off) <= 20


def test_quota_folds_without_records(spark):
    none = spark.createDataFrame([], "record_number long, label_id int")
    assert quota_folds(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, 3), (2, None)], none.schema)
    assert [r["record_number"] for r in quota_folds(nulls).collect()] == [2]


def test_batches_are_full_but_the_last(spark):
    rows = spark.range(1000).withColumnRenamed("id", "record_number")
    for cut in (batches.batches_in_order(rows, "record_number"), batches.batches_shuffled(rows, 1)):
        sizes = [r["count"] for r in cut.groupBy("batch_id").count().orderBy("batch_id").collect()]
        assert sizes == [32] * 31 + [8]


@pytest.mark.parametrize("num_steps", [1, 4, 5, 13])
def test_cycle_gives_exactly_the_steps(spark, num_steps):
    rows = spark.range(100).withColumnRenamed("id", "record_number")
    steps = batches.cycle_batches(rows, num_steps, seed=3, size=25)
    sizes = [r["count"] for r in steps.groupBy("step").count().orderBy("step").collect()]
    assert sizes == [25] * num_steps
    per_pass = steps.groupBy("pass_no").agg(F.countDistinct("record_number").alias("n"))
    assert all(r.n in (100, 25 * (num_steps % 4)) for r in per_pass.collect())


def test_diff_is_symmetric(spark):
    rng = np.random.default_rng(0)
    sides = []
    for n in (50, 43):
        rows = [(i, str(rng.integers(3))) for i in range(n)]
        sides.append(spark.createDataFrame(rows, "line_no long, line string"))
    one = compare.diff_summary(compare.line_diff(*sides)).first()
    assert one == compare.diff_summary(compare.line_diff(*sides[::-1])).first()
    assert one.length_difference == 7


def test_counts_of_the_confusion_table(spark, sf_dir):
    words = fx.predicted(spark, sf_dir)
    report = metrics.class_report(metrics.confusion(words))
    total = report.agg(F.sum("support"), F.sum("predicted")).first()
    assert total[0] == total[1] == words.count()
