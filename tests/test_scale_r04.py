"""What lies on disk at a time: words are not shuffled, and what was shuffled goes."""

import threading

import pytest
from pyspark.sql import functions as F

from titletags.functions.labels import label_rows
from titletags.operators import compare
from titletags.operators.sequences import title_words_in_context, with_neighbours
from titletags.operators.spans import decode_spans
from titletags.plans import fixtures as fx
from titletags.plans import inference, jobs, queries, tagging, training
from titletags.sources import models, tables
from tests.test_scale_parts import rows, small_parts  # noqa: F401
from tests.test_scale_r03 import plan


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return blocks.getAllBlocks().toString().count("ShuffleDataBlock")


def test_what_was_shuffled_for_a_written_table_goes(spark, tmp_path):
    df = spark.range(1000).groupBy((F.col("id") % 50).alias("record_number")).agg(F.count("*").alias("n"))
    before, conf = shuffle_files(spark), spark.conf.get(tables.FREED)
    assert tables.materialise(df).count() == 50
    tables.write_table(df.withColumn("title", F.lit("t")), str(tmp_path / "t"))
    assert df.count() == df.count() == 50
    df.select("record_number", F.lit("a").alias("aspect"), F.lit("v").alias("value"),
              F.lit(1).alias("span_no")).write.format("noop").mode("overwrite").save()
    left = shuffle_files(spark)
    tables.write_spans(df.select("record_number", F.lit("a").alias("aspect"), F.lit("v").alias("value"),
                                 F.lit(1).alias("span_no")), str(tmp_path / "s"))
    assert shuffle_files(spark) <= left and spark.conf.get(tables.FREED) == conf
    tables.materialise(df.withColumn("more", F.lit(1)))
    assert shuffle_files(spark) <= left and left - before < 40


def test_tables_written_at_a_time_leave_the_setting_as_it_was(spark):
    conf, inside = spark.conf.get(tables.FREED), threading.Barrier(3)

    def write():
        with tables.shuffles_freed(spark):
            inside.wait(20)
            inside.wait(20)

    threads = [threading.Thread(target=write) for _ in range(2)]
    for t in threads:
        t.start()
    inside.wait(20)
    assert spark.conf.get(tables.FREED) == "true"
    inside.wait(20)
    for t in threads:
        t.join()
    assert spark.conf.get(tables.FREED) == conf
    with pytest.raises(ValueError), tables.shuffles_freed(spark):
        raise ValueError
    assert spark.conf.get(tables.FREED) == conf


def test_words_are_not_shuffled_to_be_counted_per_fold(spark, sf_dir, monkeypatch, small_parts):  # noqa: F811
    plans, write = [], tables.materialise
    monkeypatch.setattr(training, "materialise", lambda df: plans.append(plan(df)) or write(df))
    examples = queries._examples(spark, sf_dir)
    assert "SortMergeJoin" in plans[0] and "hashpartitioning(record_number" not in plans[0]
    assert examples.agg(F.sum("n")).first()[0] == fx.gold(spark, sf_dir).count()


def test_neighbours_are_found_where_the_words_lie(spark):
    given = [(r, p, f"w{r}{p}", 0, 0) for r in (1, 2, 3) for p in range(4)]
    words = spark.createDataFrame(given, "record_number long, pos int, token string, _part int, _chunk int")
    long = spark.createDataFrame([(2,)], "record_number long")
    want = rows(with_neighbours(words.drop("_part", "_chunk")))
    got = with_neighbours(words, long=long, place=("_part", "_chunk"))
    assert rows(got, "record_number", "pos", "token", "prev", "next") == want
    assert {(r["_part"], r["_chunk"]) for r in got.collect()} == {(0, 0)}


def test_scores_and_labels_meet_words_where_they_lie(spark, sf_dir, small_parts):  # noqa: F811
    spans = queries.QUERIES["ensemble_spans"](spark, sf_dir)
    assert "hashpartitioning(record_number" not in plan(spans)
    labels = queries.QUERIES["ensemble_label"](spark, sf_dir)
    named = queries.lookup.with_label(labels).join(
        fx.tagged(spark, sf_dir).select("record_number", "pos", "token"), ["record_number", "pos"])
    assert rows(spans) == rows(decode_spans(named), *spans.columns)


def test_outputs_are_written_where_their_words_lie(spark, sf_dir, monkeypatch, small_parts):  # noqa: F811
    plans, write = [], tables.write_spans

    def seen(spans, *args, **kwargs):
        plans.append((plan(spans), kwargs["dealt"]))
        write(spans, *args, **kwargs)

    monkeypatch.setattr(tables, "write_spans", seen)
    queries._output_diff(spark, sf_dir)
    assert len(plans) == 2 and all(dealt and "hashpartitioning(record_number" not in p for p, dealt in plans)


@pytest.mark.parametrize("step", [1, 1000])
def test_lines_are_dealt_out_with_their_neighbours(spark, monkeypatch, step):
    monkeypatch.setattr(compare, "CHUNKS_PER_PART", 2)
    left = {i * step: f"a{i}" for i in range(200)}
    right = {i * step: f"a{i + (i % 3 == 0)}" for i in range(230)}
    a, b = (spark.createDataFrame(list(x.items()), "line_no long, line string") for x in (left, right))
    diff = compare.line_diff(a, b, lines_per_chunk=10)
    assert diff.columns == ["line_no", "line_a", "line_b"]
    assert plan(diff).count("shufflepartitionidpassthrough") == 2 and "Exchange hashpartitioning(line_no" not in plan(diff)
    want = {(n, left.get(n), right.get(n)) for n in right if left.get(n) != right[n]}
    assert set(map(tuple, diff.collect())) == want


@pytest.mark.parametrize("limit, dealt", [(40, True), (10, False)])
def test_titles_are_shuffled_not_their_words(spark, tmp_path, monkeypatch, limit, dealt):
    """With many contexts words are, and the output is in the same order."""
    ids = {row[1]: row[0] for row in label_rows()}

    def score(contexts, model, out="label_id"):
        label = F.when(F.col("token").rlike("^[0-9]"), ids["No Tag"]).when(
            F.col("token") == "Air", ids["Modell"]).otherwise(ids["Marke"])
        return contexts.withColumn(out, label)

    seen, write = [], tables.write_spans

    def written(spans, *args, **kwargs):
        seen.append((plan(spans), kwargs["dealt"], spans.rdd.getNumPartitions()))
        write(spans, *args, **kwargs)

    monkeypatch.setattr(tagging, "score", score)
    monkeypatch.setattr(models, "load_model", lambda spark, path: ("model", None))
    monkeypatch.setattr(tables, "write_spans", written)
    monkeypatch.setattr(inference, "ROWS_PER_CHUNK", limit)
    titles = spark.createDataFrame(
        [(i % 60 if i % 7 else None, f"Nike{i % 5} Air {i % 3}") for i in range(90)], "record_number long, title string")
    tables.write_table(titles, str(tmp_path / "t"))
    jobs.label_titles(spark, str(tmp_path / "t"), ["m"], str(tmp_path / "out"))
    read = tables.read_titles(spark, str(tmp_path / "t"))
    want = [line for r in read.orderBy("row_idx").collect() for a, v in (("Marke", 0), ("Modell", 1))
            for line in [(r["record_number"], a, r["title"].split()[v])]]
    lines = tables.read_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()
    assert [r["line"].rstrip("\r") for r in lines] == ["\t".join(["" if x is None else str(x) for x in w]) for w in want]
    text, was_dealt, parts = seen[0]
    assert was_dealt is dealt and (parts > 1 or not dealt)
    assert ("Exchange" not in text.split("Generate")[0].replace("BroadcastExchange", "")) is dealt

    plain = decode_spans(queries.lookup.with_label(score(title_words_in_context(read), "model")))
    got = inference.infer_spans(read, ["model"])
    assert {r[0] for r in got.select("record_number").collect()} == {w[0] for w in want}
    alone = read.filter("record_number is not null").groupBy("record_number").count().filter("count = 1")
    on = alone.select("record_number")
    assert rows(got.join(on, "record_number"), *plain.columns) == rows(plain.join(on, "record_number"), *plain.columns)
