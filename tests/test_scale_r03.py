"""What a task, a shuffle or a file holds must not grow faster than the input."""

from pyspark.sql import functions as F

from titletags.operators import ensemble, ordered, vocabulary
from titletags.operators.fill import forward_fill
from titletags.operators.sequences import title_words_in_context
from titletags.plans import fixtures as fx
from titletags.plans import tagging
from titletags.plans.queries import _hashed
from titletags.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_of_the_fill_holds_no_more_of_a_larger_table(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_CHUNK", 50)
    n = 300 * 50
    rows = spark.range(n).select(
        F.col("id").alias("row_idx"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("t"), "id")).alias("tag"))
    done = forward_fill(rows, rows_per_chunk=50)
    wrong = done.filter(F.col("tag") != F.concat(F.lit("t"), F.col("row_idx") - F.col("row_idx") % 7))
    assert done.count() == n and wrong.count() == 0
    sizes = done.groupBy(F.spark_partition_id().alias("p")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 200


def test_small_chunks_share_a_partition():
    chunks = ordered.Chunks(tuple(range(1, 1000)), rows_each=1000)
    assert chunks.parts == 4


def test_hashed_order_of_large_numbers(spark):
    orders = [0, 1, 255, 10**7, 92_160_000_000, 4_294_967_290, 2**62]
    got = spark.createDataFrame([(o,) for o in orders], "o long").select("o", _hashed(F.col("o")).alias("h"))
    assert all(r["h"] == r["o"] * 2654435761 % 4294967291 for r in got.collect())


def test_numbering_rows_shuffles_none_of_them(spark, tmp_path):
    tables.write_table(spark.range(100).select(F.col("id").alias("record_number"), F.lit("t").alias("title")),
                       str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = tables.read_titles(spark, str(tmp_path / "t"))
        assert "BroadcastHashJoin" in plan(rows) and "SortMergeJoin" not in plan(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_are_not_shuffled_with_their_titles(spark, sf_dir):
    """The order of the file is that of row_idx, and no shuffle is above the words."""
    rows = fx.tagged_with_title_in_order(spark, sf_dir)
    words = plan(rows).split("Generate")[0]
    assert "Exchange" not in words
    wanted = fx.tagged(spark, sf_dir).join(fx.titles(spark, sf_dir), "record_number")
    got = rows.select("row_idx").collect()
    assert [r[0] for r in got] == sorted(r[0] for r in got)
    assert sorted(map(tuple, rows.select(*wanted.columns).collect()), key=repr) == sorted(
        map(tuple, wanted.collect()), key=repr)


def test_scores_of_a_word_stay_where_they_are(spark, sf_dir):
    mean = ensemble.mean_probability(fx.probabilities(spark, sf_dir), fx.N_MODELS)
    for rows in (ensemble.softmax_rows(fx.logits(spark, sf_dir)), ensemble.best_label(mean)):
        assert "Exchange" not in plan(rows).split("Generate")[0]


def test_pieces_of_words_are_written_before_they_are_joined(spark):
    words = spark.createDataFrame([("ab",), ("ab",), (None,)], "token string")
    pieces = spark.createDataFrame([("a", 3), ("##b", 4)], "piece string, piece_id int")
    done = vocabulary.with_vocabulary_ids(words, pieces, 2)
    assert "Generate" not in plan(done)
    assert sorted(map(repr, (r["piece_ids"] for r in done.collect()))) == ["None", "[3, 4]", "[3, 4]"]


def test_each_context_is_scored_once(spark, monkeypatch):
    seen = []

    def score(contexts, model, out):
        seen.append(contexts.count())
        return contexts.withColumn(out, F.length("token"))

    monkeypatch.setattr(tagging, "score", score)
    titles = spark.createDataFrame([(i, "Nike Air 90") for i in range(50)], "record_number long, title string")
    words = title_words_in_context(titles)
    done = tagging.score_contexts(words, ["model"])
    assert seen == [3] and done.columns == [*words.columns, "label_id"]
    assert done.filter(F.col("label_id") != F.length("token")).count() == 0 and done.count() == 150
