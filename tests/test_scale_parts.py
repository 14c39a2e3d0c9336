"""Words are dealt out by record before they are made, and shuffles by key as rows ask for."""

import pytest
from pyspark.sql import functions as F

from titletags.functions import arrays
from titletags.operators import folds, ordered
from titletags.operators.fill import forward_fill
from titletags.operators.spans import decode_spans
from titletags.plans import fixtures as fx
from titletags.plans import queries
from titletags.sources import tables
from tests.test_scale_r03 import plan


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture
def small_parts(monkeypatch):
    """So few rows to a partition that the tables at hand need many."""
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 500)
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 5000)
    chunks = fx.tagged_chunks
    monkeypatch.setattr(fx, "tagged_chunks", lambda spark, sf_dir: chunks(spark, sf_dir, 5000))


def test_tails_of_chunks_are_made_once(spark):
    df = spark.range(3000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 7 == 0, "t").alias("tag"))
    df = forward_fill(df, rows_per_chunk=10)
    assert df.count() == df.filter("tag = 't'").count() == 3000
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("functions=[max_by(tag") + final.count("functions=[partial_max_by(tag") == 2


@pytest.mark.parametrize("inner", [False, True])
def test_words_are_not_shuffled_to_be_filled(spark, sf_dir, inner):
    filled = fx.filled(spark, sf_dir, inner)
    assert "Exchange" not in plan(filled).split("Generate")[0]
    wanted = forward_fill(fx.tagged(spark, sf_dir), inner=inner)
    assert filled.columns == wanted.columns and rows(filled) == rows(wanted)


def test_fill_in_many_parts(spark, sf_dir):
    chunks = fx.tagged_chunks(spark, sf_dir, 300)
    words = fx._tagged_words(fx._in_chunks(fx.records(spark, sf_dir), chunks), *fx.PLACE)
    got = forward_fill(words, inner=True, chunks=chunks, placed=True).drop(*fx.PLACE)
    assert chunks.count > ordered.FANOUT // 2 and rows(got) == rows(fx.filled(spark, sf_dir))


def test_softmax_of_arrays_of_any_size(spark):
    given = [([1.0, 2.0, 4.5],), ([0.0, 0.0, 0.0],), ([800.0, -800.0, 799.0],), ([1.0, 2.0],), ([],), (None,),
             ([1.0, 2.0, 3.0, 4.0],), ([1.0, None, 2.0],)]
    df = spark.createDataFrame(given, "logits array<double>")
    both = arrays.with_softmax(df, "logits", 3).withColumn("wanted", arrays.softmax(F.col("logits")))
    assert both.columns == ["logits", "prob", "wanted"]
    assert all(r["prob"] == r["wanted"] for r in both.collect())


def test_shuffles_by_key_grow_in_number(spark, small_parts):
    df = spark.range(20_000).select((F.col("id") % 4000).alias("k"))
    dealt = ordered.by_keys(df, ["k"], df.count())
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"))
    assert dealt.rdd.getNumPartitions() == 40 and sizes.first()[0] < 1500
    assert ordered.by_keys(df, ["k"], 500) is df


def test_shuffles_by_key_are_not_put_together_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 5000)
    df = spark.range(20_000).select((F.col("id") % 4000).alias("k"))
    dealt = ordered.by_keys(df, ["k"], df.count())
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count"))
    assert "REPARTITION_BY_NUM" in plan(dealt) and sizes.first()[0] < 5000


def test_many_parts_are_not_broadcast(spark, sf_dir, monkeypatch):
    want = rows(fx.records(spark, sf_dir))
    monkeypatch.setattr(fx, "ROWS_PER_CHUNK", 50)
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 500)
    got = fx.records(spark, sf_dir)
    assert "SortMergeJoin" in plan(got) and "BroadcastHashJoin" not in plan(got)
    assert plan(got).count("Exchange hashpartitioning(p_partkey") == 2
    assert rows(got) == want


def test_labels_are_counted_where_the_words_lie(spark, sf_dir):
    words = fx.gold_in_parts(spark, sf_dir).withColumnRenamed("y", "label_id")
    there = folds.record_label_counts(words, place=fx.PLACE)
    assert "hashpartitioning(record_number" not in plan(there)
    assert rows(there) == rows(folds.record_label_counts(words))


def test_folds_in_many_parts(spark, sf_dir, monkeypatch):
    want = {q: rows(queries.QUERIES[q](spark, sf_dir)) for q in ("stratified_folds", "test_fold_words")}
    examples = rows(queries._examples(spark, sf_dir))
    monkeypatch.setattr(ordered, "ROWS_PER_PART", 500)
    counts = queries._record_labels(spark, sf_dir)
    assert folds.strata(counts).rdd.getNumPartitions() > 8
    assert {q: rows(queries.QUERIES[q](spark, sf_dir)) for q in want} == want
    assert rows(queries._examples(spark, sf_dir)) == examples


def test_spans_are_made_and_written_where_the_words_lie(spark, sf_dir, small_parts):
    spans = queries._gold_spans(spark, sf_dir)
    assert "hashpartitioning(record_number" not in plan(spans)
    wanted = decode_spans(queries._labelled(spark, sf_dir)).orderBy("record_number", "span_no")
    path = queries._span_file(spark, spans, dealt=True)
    lines = tables.read_lines(spark, path).orderBy("line_no").select("line")
    other = tables.read_lines(spark, queries._span_file(spark, wanted)).orderBy("line_no").select("line")
    assert spans.rdd.getNumPartitions() > 1 and lines.collect() == other.collect()


@pytest.mark.parametrize("query", ["word_sequences", "token_tag_pairs", "pseudo_labels_all_pieces"])
def test_words_are_gathered_where_they_lie(spark, sf_dir, query):
    df = queries.QUERIES[query](spark, sf_dir)
    assert "hashpartitioning(record_number" not in plan(df)
    assert df.select("record_number").distinct().count() == fx.records(spark, sf_dir).count()
