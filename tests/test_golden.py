"""Small inputs whose results were worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tests.plain import forward_fill_single
from titletags.functions import arrays
from titletags.functions.labels import N_LABELS, label_rows
from titletags.functions.text import char_pieces, split_words
from titletags.operators import batches, compare, ensemble, metrics, pieces
from titletags.operators import sequences as seqs
from titletags.operators.fill import forward_fill
from titletags.operators.ordered import long_records
from titletags.operators.spans import decode_spans


def ids(label):
    return {row[1]: row[0] for row in label_rows()}[label]


def test_label_dictionary():
    assert N_LABELS == 70 == len(label_rows())
    assert [r[0] for r in label_rows()] == list(range(70))
    expected = {"No Tag": 0, "Obscure": 1, "Marke": 20, "Modell": 22, "Modell-I": 56,
                "Zwischensohlen-Typ": 35, "Zwischensohlen-Typ-I": 69}
    assert {k: ids(k) for k in expected} == expected


TAGS = [None, "Marke", None, None, "No Tag", None, "Modell", None, "Obscure", None]
INNER = [None, "Marke", "Marke-I", "Marke-I", "No Tag", "No Tag", "Modell", "Modell-I",
         "Obscure", "Obscure"]
PLAIN = [None, "Marke", "Marke", "Marke", "No Tag", "No Tag", "Modell", "Modell",
         "Obscure", "Obscure"]


@pytest.mark.parametrize("rows_per_chunk", [1, 2, 3, 4, 7, 100])
def test_fill(spark, rows_per_chunk):
    df = spark.createDataFrame(list(enumerate(TAGS)), "row_idx long, tag string")

    def tags(filled):
        return [r.tag for r in filled.orderBy("row_idx").collect()]

    assert tags(forward_fill(df, inner=True, rows_per_chunk=rows_per_chunk)) == INNER
    assert tags(forward_fill(df, rows_per_chunk=rows_per_chunk)) == PLAIN
    assert tags(forward_fill_single(df, inner=True)) == INNER
    once = forward_fill(df, rows_per_chunk=rows_per_chunk)
    assert tags(forward_fill(once, rows_per_chunk=rows_per_chunk)) == PLAIN


@pytest.mark.parametrize("rows_per_chunk", [1, 2, 100])
def test_fill_within_record(spark, rows_per_chunk):
    rows = [(0, 1, "Marke"), (1, 1, None), (2, 2, None), (3, 2, "Farbe"), (4, 2, None), (5, 3, None)]
    df = spark.createDataFrame(rows, "row_idx long, record_number long, tag string")
    filled = forward_fill(df, partition_by=["record_number"], rows_per_chunk=rows_per_chunk)
    assert [r.tag for r in filled.orderBy("row_idx").collect()] == [
        "Marke", "Marke", None, "Farbe", "Farbe", None
    ]


SPAN_WORDS = [
    (1, 0, "neu", "Obscure"), (1, 1, "Air", "Modell-I"), (1, 2, "Max", "Modell-I"),
    (1, 3, "für", "No Tag"), (1, 4, "90", "Farbe-I"), (1, 5, "Nike", "Marke"),
    (2, 0, "Adidas", "Marke"), (2, 1, "rot", "Farbe"), (2, 2, "x", "No Tag"),
    (3, 0, "y", "No Tag"),
]
SPANS = [(1, 1, "Modell", "Air Max 90"), (1, 2, "Marke", "Nike"),
         (2, 1, "Marke", "Adidas"), (2, 2, "Farbe", "rot")]


def _spans(df):
    return [tuple(r) for r in df.orderBy("record_number", "span_no").collect()]


def test_spans(spark):
    words = spark.createDataFrame(SPAN_WORDS, "record_number long, pos int, token string, label string")
    assert _spans(decode_spans(words)) == SPANS
    assert _spans(decode_spans(words, long=long_records(words))) == SPANS


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
@pytest.mark.parametrize("chunk", [1, 2, 4])
def test_spans_of_long_records(spark, monkeypatch, limit, chunk):
    from titletags.operators import spans

    monkeypatch.setattr(spans, "range_chunk", lambda c: F.floor(c / chunk).cast("long"))
    words = spark.createDataFrame(SPAN_WORDS, "record_number long, pos int, token string, label string")
    assert _spans(decode_spans(words, long=long_records(words, limit=limit))) == SPANS


def test_f1_forms(spark):
    df = spark.createDataFrame(
        list(zip([0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 1])), "y int, p int"
    )
    report = metrics.class_report(metrics.confusion(df)).cache()
    f1 = [r.f1 for r in report.orderBy("label_id").collect()]
    assert f1 == pytest.approx([0.8, 0, 0])
    assert metrics.f1_macro(report).first().f1 == pytest.approx(0.266667, abs=1e-6)
    assert metrics.f1_micro(report).first().f1 == pytest.approx(0.333333, abs=1e-6)
    assert metrics.f1_weighted(report).first().f1 == pytest.approx(0.266667, abs=1e-6)


def test_aspect_f1(spark):
    df = spark.createDataFrame(
        list(zip([0, 2, 2, 3, 1, 3], [2, 2, 0, 3, 1, 2])), "y int, p int"
    )
    report = metrics.class_report(metrics.confusion(df))
    assert metrics.f1_aspects(report).first().f1 == pytest.approx(0.533333, abs=1e-6)
    assert metrics.f1_weighted(report).first().f1 == pytest.approx(0.522222, abs=1e-6)


def test_weighted_f1_equals_mllib(spark, sf_dir):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from titletags.plans import fixtures as fx

    words = fx.predicted(spark, sf_dir).select(F.col("y").cast("double"), F.col("p").cast("double"))
    evaluator = MulticlassClassificationEvaluator(metricName="f1", labelCol="y", predictionCol="p")
    ours = metrics.f1_weighted(metrics.class_report(metrics.confusion(words))).first().f1
    assert ours == pytest.approx(evaluator.evaluate(words))


def test_best_so_far(spark):
    scores = [(0, i, f) for i, f in enumerate([0.0, 0.5, 0.5, 0.4, 0.7, 0.7])]
    df = spark.createDataFrame(scores, "fold int, epoch int, f1 double")
    marked = metrics.best_so_far(df).orderBy("epoch").collect()
    assert [r.is_best for r in marked] == [False, True, False, False, True, False]
    assert metrics.best_step(df).first().epoch == 4


def test_diff(spark):
    a = spark.createDataFrame(list(enumerate("abc", 1)), "line_no long, line string")
    b = spark.createDataFrame(list(enumerate("axcd", 1)), "line_no long, line string")
    diff = compare.line_diff(a, b)
    assert [tuple(r) for r in diff.orderBy("line_no").collect()] == [(2, "b", "x"), (4, None, "d")]
    for pair in ((a, b), (b, a)):
        summary = compare.diff_summary(compare.line_diff(*pair)).first()
        assert (summary.differences, summary.length_difference, summary.identical) == (2, 1, 0)
    assert compare.diff_summary(compare.line_diff(a, a)).first().identical == 1


def test_align(spark):
    words = [(0, 20, [9, 8]), (1, 22, [7])]
    df = spark.createDataFrame(words, "pos int, label_id int, piece_ids array<int>").withColumn(
        "record_number", F.lit(1)
    )
    seq = seqs.word_sequences(df, F.struct("label_id", "piece_ids"))
    row = pieces.align_sequences(seq).first()
    assert row.ids == [0, 9, 8, 7, 2]
    assert row.labels == [None, 20, None, 22, None]
    cut = pieces.truncate(pieces.align_sequences(seq), 4).first()
    assert (cut.ids, cut.labels) == ([0, 9, 8, 2], [None, 20, None, None])
    long = pieces.align_words(df).orderBy("pos", "piece_no").collect()
    assert [(r.piece_id, r.label_id) for r in long] == [(9, 20), (8, None), (7, 22)]
    every = pieces.align_words(df, first_piece_only=False).orderBy("pos", "piece_no").collect()
    assert [(r.piece_id, r.label_id) for r in every] == [(9, 20), (8, 20), (7, 22)]


def test_word_without_pieces_gives_no_row(spark):
    df = spark.createDataFrame([(0, 20, []), (1, 22, [7])], "pos int, label_id int, piece_ids array<int>")
    assert [r.label_id for r in pieces.align_words(df).collect()] == [22]


def test_long_sequence_in_parts(spark):
    df = spark.createDataFrame([(1, i, f"t{i}", "x") for i in range(5)],
                               "record_number long, pos int, token string, tag string")
    rows = seqs.word_sequences(df, part_words=2).orderBy("part").collect()
    assert [[w.v.token for w in r.seq] for r in rows] == [["t0", "t1"], ["t2", "t3"], ["t4"]]


def test_ensemble(spark):
    rows = [(1, 0, m, i, p) for m, ps in enumerate([(0.6, 0.4, 0.0), (0.1, 0.5, 0.4)])
            for i, p in enumerate(ps)]
    df = spark.createDataFrame(
        rows, "record_number long, pos int, model_id int, label_id int, prob double"
    )
    mean = ensemble.mean_probability(df)
    assert [r.prob for r in mean.orderBy("label_id").collect()] == pytest.approx([0.35, 0.45, 0.2])
    assert ensemble.best_label(mean).first().label_id == 1
    wide = spark.createDataFrame([([0.6, 0.4, 0.0], [0.1, 0.5, 0.4])], "a array<double>, b array<double>")
    assert wide.select(arrays.argmax(arrays.mean([F.col("a"), F.col("b")]))).first()[0] == 1


def test_ties_go_to_the_lowest_label(spark):
    rows = [(1, 0, i, 0.5) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "record_number long, pos int, label_id int, prob double")
    assert ensemble.best_label(df).first().label_id == 1
    assert spark.range(1).select(arrays.argmax(F.array(*map(F.lit, [1.0, 2.0, 2.0])))).first()[0] == 1


def test_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, -5.0],)], "l array<double>")
    p = df.select(arrays.softmax(F.col("l"))).first()[0]
    assert sum(p) == pytest.approx(1.0)
    assert p[1] / p[0] == pytest.approx(2.718281828)


def test_pad(spark):
    df = spark.createDataFrame(
        [(0, 0, [0, 9, 2], [None, 5, None]), (0, 1, [0, 9, 8, 7, 2], [None, 5, None, 6, None])],
        "batch_id long, slot int, ids array<int>, labels array<int>",
    )
    rows = batches.pad_batches(df).orderBy("slot").collect()
    assert [r.ids for r in rows] == [[0, 9, 2, 1, 1], [0, 9, 8, 7, 2]]
    assert [r["mask"] for r in rows] == [[1, 1, 1, 0, 0], [1, 1, 1, 1, 1]]
    assert rows[0].labels == [None, 5, None, None, None]


def test_mask_predictions(spark):
    df = spark.createDataFrame([([0, 9, 8, 2, 1, 1], [5, 20, 56, 5, 5, 5])], "i array<int>, p array<int>")
    masked = df.select(pieces.mask_predictions(F.col("i"), F.col("p"))).first()[0]
    assert masked == [None, 20, 56, None, None, None]


@pytest.mark.parametrize("title", [
    "", "  ", "a", " a  b ", "a b", "a　b c", "\ta\x1cb\x1dc\x1ed\x1fe\x85f ", "für​x y",
])
def test_words_as_python_splits_them(spark, title):
    df = spark.createDataFrame([(title,)], "title string")
    assert df.select(split_words(F.col("title"))).first()[0] == title.split()
    rows = seqs.title_words_in_context(df, keep=()).orderBy("pos").collect()
    words = title.split()
    assert [r.token for r in rows] == words
    assert [r.prev for r in rows] == ([None] + words)[: len(words)]
    assert [r.next for r in rows] == (words[1:] + [None])[: len(words)]


def test_pieces(spark):
    df = spark.createDataFrame([("Turnschuhe",), ("ab",), ("",)], "w string")
    assert [r[0] for r in df.select(char_pieces(F.col("w"))).collect()] == [
        ["Turn", "schu", "he"], ["ab"], []
    ]


def test_tokenizer_sees_each_word_of_a_batch_once(spark):
    def tokenize(words):
        assert len(words) == len(set(words))
        return [[len(w)] for w in words]

    df = spark.createDataFrame([("aa",), ("b",), ("aa",), (None,)], "token string").coalesce(1)
    rows = pieces.with_piece_ids(df, tokenizer=pieces.tokenizer_udf(tokenize)).collect()
    assert [r.piece_ids for r in rows] == [[2], [1], [2], None]
