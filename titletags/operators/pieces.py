"""Word pieces and label alignment."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.functions.text import CLS_ID, PAD_ID, SEP_ID, char_piece_ids
from titletags.operators.lookup import with_label

WordTokenizer = Callable[[list[str]], list[list[int]]]


def tokenizer_udf(tokenize: WordTokenizer) -> Callable[[Column], Column]:
    """Wrap a caller's tokenizer, which maps a list of words to lists of piece ids.

    It runs in Arrow batches inside the tasks that hold the words, and sees each
    distinct word of a batch once; no word travels through a shuffle for it, so a
    word that fills a third of the table makes no hot key.
    """

    @F.pandas_udf("array<int>")
    def run(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        ids = [list(map(int, i)) for i in tokenize(list(distinct))]
        return pd.Series([ids[c] if c >= 0 else None for c in codes], dtype=object)

    return run


def with_piece_ids(words: DataFrame, token: str = "token",
                   tokenizer: Callable[[Column], Column] = char_piece_ids,
                   out: str = "piece_ids") -> DataFrame:
    return words.withColumn(out, tokenizer(F.col(token)))


def align_words(words: DataFrame, label_id: str = "label_id", piece_ids: str = "piece_ids",
                first_piece_only: bool = True) -> DataFrame:
    """One row per piece; only the first piece of a word carries its label.

    With `first_piece_only` off every piece carries it, as in pseudo-labels. A word
    without pieces gives no row.
    """
    exploded = words.select(
        *[c for c in words.columns if c not in (label_id, piece_ids)],
        F.col(label_id).alias("_label"),
        F.posexplode(piece_ids).alias("piece_no", "piece_id"),
    )
    carries = F.lit(not first_piece_only) | (F.col("piece_no") == 0)
    return exploded.withColumn(label_id, F.when(carries, F.col("_label"))).drop("_label")


def piece_check(words: DataFrame, record: str = "record_number",
                piece_ids: str = "piece_ids") -> DataFrame:
    """Words per record, and those the tokenizer gave no piece for."""
    without = F.coalesce(F.size(piece_ids), F.lit(0)) <= 0
    return words.groupBy(record).agg(
        F.count("*").alias("n_words"), F.count(F.when(without, 1)).alias("n_without"))


def align_sequences(sequences: DataFrame, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> DataFrame:
    """Piece ids and labels of whole sequences, with sentinels at both ends.

    Takes `seq` from `word_sequences` with the fields `label_id` and `piece_ids`;
    positions that carry no label are NULL.
    """
    ids = F.transform("seq", lambda w: w["v"]["piece_ids"])
    labels = F.transform(
        "seq",
        lambda w: F.transform(
            w["v"]["piece_ids"], lambda _, i: F.when(i == 0, w["v"]["label_id"])
        ),
    )
    none = F.array(F.lit(None).cast("int"))
    return sequences.select(
        *[c for c in sequences.columns if c != "seq"],
        F.concat(F.array(F.lit(cls_id)), F.flatten(ids), F.array(F.lit(sep_id))).alias("ids"),
        F.concat(none, F.flatten(labels), none).alias("labels"),
    )


def unalign(pieces: DataFrame, label_id: str = "label_id") -> DataFrame:
    """Pieces that carry a label, with the label's text."""
    return with_label(pieces.filter(F.col(label_id).isNotNull()), label_id)


def truncate(sequences: DataFrame, length: int, columns: tuple[str, ...] = ("ids", "labels"),
             sep_id: int = SEP_ID) -> DataFrame:
    """Cut sequences to `length` pieces. A cut sequence keeps its end sentinel."""
    cut = F.size(columns[0]) > length

    def shorten(name: str) -> Column:
        last = F.lit(sep_id) if name == columns[0] else F.lit(None).cast("int")
        return F.when(
            cut, F.concat(F.slice(name, 1, length - 1), F.array(last))
        ).otherwise(F.col(name))

    return sequences.withColumns({c: shorten(c) for c in columns})


def mask_predictions(ids: Column, predictions: Column, sep_id: int = SEP_ID,
                     pad_id: int = PAD_ID) -> Column:
    """Blank the predictions on the start, end and padding pieces."""
    paired = F.arrays_zip(ids.alias("id"), predictions.alias("p"))
    return F.transform(
        paired,
        lambda x, i: F.when(
            (i > 0) & (x["id"] != sep_id) & (x["id"] != pad_id), x["p"]
        ),
    )
