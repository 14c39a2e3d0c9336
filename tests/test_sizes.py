"""Results that must not depend on sizes, splits, ranges of values or missing keys."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from titletags import session
from titletags.functions.features import CONTEXT
from titletags.operators import ensemble, metrics, pieces
from titletags.operators import sequences as seqs
from titletags.operators.fill import forward_fill
from titletags.operators.ordered import digest_chunk
from titletags.operators.spans import decode_spans
from titletags.plans import tagging
from titletags.sources import tables


def test_row_numbers_survive_other_splits(spark, tmp_path):
    path = str(tmp_path / "titles")
    n = 60_000
    titles = spark.range(n).select(F.col("id").alias("record_number"),
                                   F.concat(F.lit("Nike Air "), "id").alias("title"))
    tables.write_table(titles.coalesce(1), path)
    settings = {"spark.sql.files.maxPartitionBytes": "300000", "spark.sql.files.minPartitionNum": "4"}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        rows = tables.read_titles(spark, path)
        spark.conf.set("spark.sql.files.minPartitionNum", "9")
        got = rows.agg(F.count("*"), F.min("row_idx"), F.max("row_idx"),
                       F.countDistinct("row_idx"),
                       F.sum((F.col("row_idx") != F.col("record_number")).cast("int"))).first()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert tuple(got) == (n, 0, n - 1, n, 0)


def test_parts_are_ordered_as_numbers(spark, tmp_path):
    for number in ("99999", "100000", "00002", "10001"):
        (tmp_path / f"part-{number}-x.txt").write_text(f"{int(number)}\n")
    lines = tables.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [int(r["line"]) for r in lines] == [2, 10001, 99999, 100000]


@pytest.mark.parametrize("line", ["x12\tNike", "3\tPuma\textra"])
def test_malformed_lines_end_the_job(spark, tmp_path, line):
    path = tmp_path / "titles.tsv"
    path.write_text(f"Record Number\tTitle\n1\tNike Air\n{line}\n")
    with pytest.raises(PySparkException, match="malformed line"):
        tables.read_titles(spark, str(path)).collect()


def test_missing_fields_are_empty(spark, tmp_path):
    path = tmp_path / "tagged.tsv"
    path.write_text("Record Number\tTitle\tToken\tTag\n1\tNike Air\tNike\tMarke\n"
                    "1\tNike Air\tAir\n\tNike\tNike\tMarke\n")
    rows = tables.read_tagged(spark, str(path)).orderBy("row_idx").collect()
    assert [tuple(r)[:4] for r in rows] == [
        (1, "Nike Air", "Nike", "Marke"), (1, "Nike Air", "Air", None), (None, "Nike", "Nike", "Marke")]


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_base(Session())
    Session.conf = {"spark.checkpoint.dir": "s3://bucket/shared"}
    assert session.shared_base(Session()) == "s3://bucket/shared"


def test_long_records_are_one_sequence(spark):
    words = spark.range(70_000).select(
        F.lit(1).alias("record_number"), F.col("id").cast("int").alias("pos"),
        F.lit(5).alias("label_id"), F.array(F.lit(7), F.lit(8)).alias("piece_ids"))
    rows = seqs.word_sequences(words, F.struct("label_id", "piece_ids"))
    aligned = pieces.align_sequences(rows)
    cut = pieces.truncate(aligned, 12).collect()
    assert len(cut) == 1
    assert cut[0]["ids"] == [0, *[7, 8] * 5, 2] and cut[0]["labels"] == [None, *[5, None] * 5, None]
    assert aligned.select(F.size("ids")).first()[0] == 140_002


def test_long_spans_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr("titletags.operators.spans.range_chunk",
                        lambda order: F.call_function("div", order, F.lit(7)))
    words = spark.range(40).select(
        F.lit(1).alias("record_number"), F.col("id").alias("pos"),
        F.concat(F.lit("w"), "id").alias("token"),
        F.when(F.col("id") == 25, "Marke").otherwise("Modell-I").alias("label"))
    long = words.select("record_number").distinct()
    got = sorted(map(tuple, decode_spans(words, long=long).collect()))
    assert got == sorted(map(tuple, decode_spans(words).collect()))
    assert got[0][2:] == ("Modell", " ".join(f"w{i}" for i in range(25)))


def test_best_label_of_scores_below_zero(spark):
    rows = [(1, 0, 0, -1.0), (1, 0, 1, -2.0), (1, 1, 2000, 0.9), (1, 1, 0, 0.4),
            (1, 2, 7, -0.5), (1, 2, 3, -0.5)]
    scores = spark.createDataFrame(rows, "record_number int, pos int, label_id int, prob double")
    got = {r["pos"]: (r["label_id"], r["prob"]) for r in ensemble.best_label(scores).collect()}
    assert got == {0: (0, -1.0), 1: (2000, 0.9), 2: (3, -0.5)}
    with pytest.raises(PySparkException, match="out of range"):
        ensemble.best_label(scores.withColumn("label_id", F.col("label_id") - 1)).collect()


def test_scores_without_support_are_null(spark):
    rows = spark.createDataFrame([(0, 5), (1, 1)], "y int, p int")
    report = metrics.class_report(metrics.confusion(rows))
    assert metrics.f1_aspects(report).first()["f1"] is None
    assert metrics.f1_micro(report.filter("false")).first()["f1"] is None


def test_fill_keeps_rows_without_a_key(spark):
    rows = [(None, 1, "a"), (None, 2, None), (1, 3, None), (1, None, "b")]
    df = spark.createDataFrame(rows, "k int, row_idx long, tag string")
    got = forward_fill(df, partition_by=["k"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(repr, [(None, 1, "a"), (None, 2, "a"), (1, 3, None), (1, None, "b")]))


def test_chunks_follow_the_row_count(spark):
    rows = spark.range(5000).withColumn("digest", F.md5(F.col("id").cast("string")))
    for size, most in ((10_000, 1), (400, 16), (30, 256)):
        chunk = digest_chunk(F.col("digest"), rows, size)
        n = rows.select(chunk.alias("c")).distinct().count()
        assert most // 2 < n <= most


def test_all_features_reach_the_model(spark, monkeypatch):
    monkeypatch.setattr(tagging, "WIDTH", 8)
    words = spark.createDataFrame([(f"w{i}", "a", "b") for i in range(200)],
                                  ", ".join(f"{c} string" for c in CONTEXT))
    counts = tagging.with_features(words, 8).select(F.size("terms").alias("n")).distinct().collect()
    assert min(r["n"] for r in counts) >= 3
    places = tagging.with_features(words, 8).select(F.explode("terms").alias("t")).distinct()
    assert {int(r["t"]) for r in places.collect()} <= set(range(8))


def test_intermediate_tables_can_be_dropped(spark):
    before = tables.materialise(spark.range(3))
    assert before.count() == 3
    path = urlparse(before.inputFiles()[0]).path
    assert os.path.exists(path)
    assert tables.drop_intermediate(spark) >= 1
    assert not os.path.exists(path)
    assert tables.drop_intermediate(spark) == 0
