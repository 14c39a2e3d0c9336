"""Model jobs: row checks, and better than always the most common label."""

import pytest
from pyspark.sql import functions as F

from titletags.functions.labels import N_LABELS
from titletags.operators import folds, lookup, metrics
from titletags.operators import sequences as seqs
from titletags.plans import fixtures as fx
from titletags.plans import inference, tagging, training
from titletags.sources import models, tables


@pytest.fixture(scope="module")
def examples(spark, sf_dir):
    words = tables.materialise(lookup.with_label_id(fx.filled(spark, sf_dir), "tag"))
    assigned = folds.assign_folds(folds.record_label_counts(words))
    return training.fold_examples(seqs.with_neighbours(words), assigned)


@pytest.fixture(scope="module")
def model(examples):
    return tagging.fit_tagger(training.train_side(examples, 0), max_iter=10)


def test_examples_count_every_word(spark, sf_dir, examples):
    assert examples.agg(F.sum("n")).first()[0] == fx.gold(spark, sf_dir).count()


def test_better_than_the_majority(examples, model):
    test = training.test_side(examples, 0)
    sizes = test.groupBy("label_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"))
    always = test.withColumn("p", F.lit(sizes.first()["label_id"]))
    report = metrics.class_report(
        metrics.confusion(always, "label_id", "p", weight=F.col("n"))
    )
    assert tagging.overall_f1(test, model) > 0.9 > metrics.f1_weighted(report).first().f1


def test_every_label_has_a_probability(model):
    assert model.stages[-1].numClasses == N_LABELS


def test_ensemble_of_one_model_twice_is_that_model(spark, sf_dir, model):
    words = seqs.title_words_in_context(fx.titles(spark, sf_dir))
    one = tagging.score(words, model)
    two = tagging.score_ensemble(words, [model, model])
    assert one.exceptAll(two).count() == 0 and two.count() == one.count()


def test_saved_model(spark, sf_dir, model, tmp_path):
    models.save_model(model, str(tmp_path / "m"), 0.5)
    loaded, score = models.load_model(spark, str(tmp_path / "m"))
    assert score.first().best_f1 == 0.5
    titles = fx.titles(spark, sf_dir)
    a, b = (inference.infer_spans(titles, [m]) for m in (model, loaded))
    assert a.exceptAll(b).count() == 0 and a.count() > 0


def test_pseudo_labels_cover_every_word(spark, sf_dir, model):
    titles = fx.titles(spark, sf_dir)
    rows = inference.pseudo_labels(titles, model, 1000)
    words = seqs.title_words(titles.filter("record_number > 1000"))
    assert rows.count() == words.count()
    assert rows.filter(~F.col("label_id").between(0, N_LABELS - 1)).count() == 0


def test_self_training_starts_when_told(spark, sf_dir, examples):
    contexts = inference.unlabelled_contexts(fx.titles(spark, sf_dir), 1000)
    scores, best = training.self_train(
        training.train_side(examples, 0), training.test_side(examples, 0), contexts,
        rounds=3, start_round=2, max_iter=5,
    )
    rows = scores.orderBy("round").collect()
    assert [r.n_pseudo > 0 for r in rows] == [False, False, True]
    assert best is not None and rows[0].is_best


def test_cross_validation_keeps_one_model_per_fold(examples):
    scores, kept = training.cross_validate(examples, [0, 3], rounds=(2, 10))
    assert scores.count() == 4 and set(kept) == {0, 3}
