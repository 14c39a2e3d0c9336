"""Folds that are fitted at the same time."""

import threading

import pytest
from pyspark.sql import functions as F

from titletags.operators import folds
from titletags.operators import sequences as seqs
from titletags.plans import fixtures as fx
from titletags.plans import tagging, training


@pytest.fixture(scope="module")
def examples(spark, sf_dir):
    words = fx.gold(spark, sf_dir).withColumnRenamed("y", "label_id").cache()
    assigned = folds.assign_folds(folds.record_label_counts(words))
    return training.fold_examples(seqs.with_neighbours(words), assigned)


def rows_of(table):
    return sorted((r["fold"], r["round"], round(r["f1"], 6), r["is_best"]) for r in table.collect())


def test_at_once_and_one_after_the_other_agree(examples):
    one, models = training.cross_validate(examples, [0, 1, 2], rounds=(3,), at_once=1)
    many, others = training.cross_validate(examples, [0, 1, 2], rounds=(3,), at_once=3)
    assert rows_of(one) == rows_of(many) and len(rows_of(many)) == 3
    assert sorted(models) == sorted(others) == [0, 1, 2]


def test_folds_are_fitted_at_the_same_time(examples, monkeypatch):
    together = threading.Barrier(3, timeout=120)
    plain = tagging.fit_tagger

    def meeting(*args, **options):
        together.wait()
        return plain(*args, **options)

    monkeypatch.setattr(tagging, "fit_tagger", meeting)
    table, _ = training.cross_validate(examples, [0, 1, 2], rounds=(1,))
    assert table.count() == 3


def test_a_fold_that_fails_ends_the_others(spark, examples, monkeypatch):
    started = threading.Event()

    def fit(train, max_iter):
        if not started.is_set():
            started.set()  # the first one works for minutes unless its job is ended
            spark.range(64).repartition(64).select(F.sum(
                F.expr("java_method('java.lang.Thread', 'sleep', 5000L)").isNull().cast("int"))).collect()
            raise AssertionError("was not ended")
        raise RuntimeError("lost")

    monkeypatch.setattr(tagging, "fit_tagger", fit)
    with pytest.raises(Exception, match="lost|cancelled|canceled|CANCEL"):
        training.cross_validate(examples, [0, 1], rounds=(1,))
    assert spark.range(10).count() == 10


def test_no_folds(examples):
    table, models = training.cross_validate(examples, [], rounds=(1,))
    assert table.count() == 0 and models == {}
