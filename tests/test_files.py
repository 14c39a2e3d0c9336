"""Reading and writing text tables, and the traps in them."""

import csv

import pytest
from pyspark.sql import functions as F

from titletags.plans import jobs
from titletags.sources import tables


def test_tagged_file_traps(spark, tmp_path):
    path = tmp_path / "tagged.tsv"
    path.write_text(
        "Record Number\tTitle\tToken\tTag\n"
        '1\t"Neu" NA \\x 90\t"Neu"\tObscure\n'
        '1\t"Neu" NA \\x 90\tNA\tMarke\n'
        '1\t"Neu" NA \\x 90\t\\x\t\n'
        '1\t"Neu" NA \\x 90\t90\t\n',
        encoding="utf-8",
    )
    rows = tables.read_tagged(spark, str(path)).orderBy("row_idx").collect()
    assert [r.token for r in rows] == ['"Neu"', "NA", "\\x", "90"]
    assert [r.tag for r in rows] == ["Obscure", "Marke", None, None]
    assert [r.row_idx for r in rows] == [0, 1, 2, 3]
    assert rows[0].title == '"Neu" NA \\x 90'


def test_no_break_space_splits_words(spark, tmp_path):
    path = tmp_path / "titles.tsv"
    path.write_text("Record Number\tTitle\n7\tAir Max 90\n", encoding="utf-8")
    from titletags.operators.sequences import title_words

    words = title_words(tables.read_titles(spark, str(path))).orderBy("pos").collect()
    assert [w.token for w in words] == ["Air", "Max", "90"]


@pytest.mark.parametrize("split_bytes", [64, 1000, 1 << 20])
def test_row_index_over_files_and_splits(spark, tmp_path, split_bytes):
    """Files of different size, cut into many splits and packed in any order."""
    n = 0
    for part, lines in enumerate((3, 400, 1, 90)):
        text = "".join(f"{n + i}\ttitle {n + i}\n" for i in range(lines))
        (tmp_path / f"part-{part:05d}.csv").write_text("Record Number\tTitle\n" + text)
        n += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        rows = tables.read_titles(spark, str(tmp_path))
        assert rows.filter("row_idx <> record_number").count() == 0
        assert rows.count() == n == rows.select("row_idx").distinct().count()
        lines = tables.read_lines(spark, str(tmp_path))
        assert lines.agg(F.max("line_no")).first()[0] == n + 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_spans_file_bytes(spark, tmp_path):
    spans = [(1, 1, "Marke", "Nike"), (1, 2, "Stil", '6" boot'), (2, 1, "Modell", " Air "),
             (2, 2, "Farbe", 'größe "x"')]
    df = spark.createDataFrame(spans, "record_number long, span_no long, aspect string, value string")
    out = tmp_path / "out"
    tables.write_spans(df, str(out))
    wanted = tmp_path / "wanted.tsv"
    with open(wanted, "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f, delimiter="\t")
        writer.writerows([(r, a, v) for r, _, a, v in spans])
    written = b"".join(p.read_bytes() for p in sorted(out.glob("part-*")))
    assert written == wanted.read_bytes()
    back = tables.read_spans(spark, str(out))
    assert sorted(map(tuple, back.collect())) == sorted((r, a, v) for r, _, a, v in spans)


def test_shared_folder_is_the_clusters(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folders = [tables.shared_folder(spark) for _ in range(2)]
    assert all(f.startswith(named) for f in folders) and folders[0] != folders[1]


def test_jobs_from_file_to_file(spark, tmp_path):
    """Train on a tagged file, label titles with one and two models, compare outputs."""
    brands, colors = ["Nike", "Puma", "Asics"], ["rot", "blau"]
    tagged, titles = ["Record Number\tTitle\tToken\tTag"], ["Record Number\tTitle"]
    for i in range(60):
        brand, color = brands[i % 3], colors[i % 2]
        title = f"{brand} Air Max {color} neu"
        tags = ["Marke", "Modell", "", "Farbe", "Obscure"]
        tagged += [f"{i}\t{title}\t{w}\t{t}" for w, t in zip(title.split(), tags)]
        titles.append(f"{i}\t{title}")
    titles.append(f"0\t{titles[-1].split(chr(9))[1]}")  # a record number that comes twice
    (tmp_path / "tagged.tsv").write_text("\n".join(tagged) + "\n")
    (tmp_path / "titles.tsv").write_text("\n".join(titles) + "\n")
    tagged_path, titles_path = str(tmp_path / "tagged.tsv"), str(tmp_path / "titles.tsv")

    counts = {r.tag: (r.english, r.n) for r in jobs.tag_counts(spark, tagged_path).collect()}
    assert counts["Modell"] == ("Model", 120) and counts["Marke"] == ("Brand", 60)
    report = jobs.fold_report(spark, tagged_path, k=3, tags=("Marke", "Stil")).collect()
    assert len(report) == 6
    assert all((r.n_train, r.n_test) == ((40, 20) if r.label == "Marke" else (0, 0)) for r in report)

    models = str(tmp_path / "models")
    scores = jobs.train(spark, tagged_path, models, k=3, fold_numbers=[0, 1]).collect()
    assert {r.fold for r in scores} == {0, 1} and max(r.f1 for r in scores) == 1.0
    outputs = [str(tmp_path / name) for name in ("one", "two")]
    jobs.label_titles(spark, titles_path, [f"{models}/fold_0"], outputs[0])
    jobs.label_titles(spark, titles_path, [f"{models}/fold_{f}" for f in (0, 1)], outputs[1])
    lines = [r.line for r in tables.read_lines(spark, outputs[0]).orderBy("line_no").collect()]
    assert len(lines) == 61 * 3
    assert lines[:3] == ["0\tMarke\tNike", "0\tModell\tAir Max", "0\tFarbe\trot"]
    diff, summary = jobs.compare_outputs(spark, *outputs)
    assert diff.count() == 0 and summary.first().identical == 1
    best = jobs.score_saved(spark, tagged_path, f"{models}/fold_0")
    assert best.filter("f1 < 1").count() == 0

    semi = jobs.train_with_unlabelled(
        spark, tagged_path, titles_path, str(tmp_path / "semi"), k=3, rounds=2, lowest=30
    ).orderBy("round").collect()
    assert [r.n_pseudo for r in semi] == [0, 29 * 5]
