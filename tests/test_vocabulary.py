"""Word pieces by a vocabulary, against a plain greedy walk."""

import pytest
from pyspark.sql import functions as F

from titletags.operators import pieces, vocabulary
from titletags.operators import sequences as seqs
from titletags.plans import fixtures as fx

UNKNOWN = 1


def greedy(word, ids, mark="##"):
    if word is None:
        return None
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = (mark if at else "") + word[at:end]
            if piece in ids:
                out.append(ids[piece])
                at = end
                break
        else:
            return [UNKNOWN]
    return out


def lowest(rows):
    ids = {}
    for piece, number in rows:
        ids[piece] = min(number, ids.get(piece, number))
    return ids


PIECES = [("un", 10), ("##aff", 11), ("##able", 12), ("##a", 13), ("##f", 14), ("u", 15),
          ("##able", 5), ("##", 16), ("#", 17), ("🙂", 18), ("##🙂x", 19), ("x", 20), ("##x", 21),
          ("unaffa", 22), ("ß", 23), ("##ß", 24), ("", 25), ("##ble", 26)]
WORDS = ["unaffable", "unaff", "unaffa", "unaffablex", "un", "u", "uf", "##", "#", "###", "🙂🙂x",
         "🙂x", "ßß", "ẞ", "q", "", None, "x" * 5000, "x" * 4999 + "q", "un", "unaffable"]


def ids_of(spark, words, rows, **options):
    table = spark.createDataFrame(rows, "piece string, piece_id int")
    data = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, token string")
    found = vocabulary.with_vocabulary_ids(data, table, UNKNOWN, **options).orderBy("i").collect()
    return [r["piece_ids"] for r in found]


def test_greedy_pieces(spark):
    assert ids_of(spark, WORDS, PIECES) == [greedy(w, lowest(PIECES)) for w in WORDS]


def test_other_mark_and_no_vocabulary(spark):
    rows = [("a", 1), ("@b", 2), ("@@", 3), ("@", 4)]
    words = ["ab", "a@", "@", "b", "abb", "@b"]
    assert ids_of(spark, words, rows, mark="@") == [
        greedy(w, dict(rows), "@") for w in words]
    assert ids_of(spark, ["a", "", None], []) == [[UNKNOWN], [], None]


@pytest.mark.parametrize("name", ["part", "documents"])
def test_words_of_the_tables(spark, sf_dir, name):
    column = {"part": F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size"),
              "documents": F.col("text")}[name]
    rows = fx.table(spark, sf_dir, name).select(F.lit(0).alias("k"), column.alias("title"))
    words = seqs.title_words(rows, keep=("k",)).select("token")
    table = fx.vocabulary(spark, sf_dir)
    ids = {r["piece"]: r["piece_id"] for r in table.collect()}
    found = vocabulary.with_vocabulary_ids(words, table, UNKNOWN).collect()
    assert len(found) == words.count()
    assert all(r["piece_ids"] == greedy(r["token"], ids) for r in found)
    known = sum(r["piece_ids"] != [UNKNOWN] for r in found)
    assert 0 < known < len(found)


def test_pieces_carry_labels(spark):
    table = spark.createDataFrame(PIECES, "piece string, piece_id int")
    words = spark.createDataFrame([(1, 0, "unaffable", 20), (1, 1, "", 3), (1, 2, "q", 4)],
                                  "record_number int, pos int, token string, label_id int")
    aligned = pieces.align_words(vocabulary.with_vocabulary_ids(words, table, UNKNOWN))
    got = aligned.orderBy("pos", "piece_no").select("pos", "piece_id", "label_id").collect()
    assert [tuple(r) for r in got] == [(0, 22, 20), (0, 26, None), (2, UNKNOWN, 4)]
