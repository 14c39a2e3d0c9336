"""Word pieces by a vocabulary table: greedy longest match.

A word is cut from its start: the longest piece of the vocabulary that the rest begins with
comes next. A piece inside a word carries a mark in the vocabulary, as `##ing`. A word that
cannot be cut to its end is unknown as a whole.

Scale: every distinct word is cut once. Its parts up to the length of the longest piece meet
the vocabulary in one join on the text of the piece, so the vocabulary may have any size; the
longest match of each place is an aggregation, and the way through the places runs within
the row of the word. Words meet their pieces in a join on the word; where a word is very
frequent, Spark splits it as a skewed join, or has broadcast the pieces by their measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.sources.tables import materialise

MARK = "##"


def longest_matches(words: DataFrame, vocabulary: DataFrame, token: str = "token",
                    mark: str = MARK) -> DataFrame:
    """(token, places): for each place of a distinct word, in order, the number of letters
    and the id of the longest piece that matches there, NULL where none does.

    `vocabulary` is (piece, piece_id). Of a piece that is listed twice the lowest id counts.
    """
    pieces = vocabulary.filter(F.length("piece") > 0).groupBy("piece").agg(
        F.min("piece_id").alias("piece_id"))
    longest = pieces.agg(F.coalesce(F.max(F.length("piece")), F.lit(0))).scalar()

    distinct = words.select(token).filter(F.length(token) > 0).distinct()
    starts = distinct.select(token, F.explode(F.sequence(F.lit(1), F.length(token))).alias("_at"))
    room = F.least(longest, F.length(token) - F.col("_at") + 1)
    parts = starts.select(token, "_at", F.explode_outer(
        F.when(room > 0, F.sequence(F.lit(1), room))).alias("_letters"))
    text = F.substring(token, F.col("_at"), F.col("_letters"))
    parts = parts.withColumn("piece", F.when(F.col("_at") > 1, F.concat(F.lit(mark), text))
                             .otherwise(text))
    matched = parts.join(pieces, "piece", "left")
    best = F.max(F.when(F.col("piece_id").isNotNull(), F.struct("_letters", "piece_id")))
    return (
        matched.groupBy(token, "_at").agg(best.alias("_best"))
        .groupBy(token)
        .agg(F.array_sort(F.collect_list(F.struct("_at", "_best")))["_best"].alias("places"))
    )


def greedy_pieces(places: Column, unknown_id: int) -> Column:
    """Ids on the way from the first place to the end, or the unknown id alone."""
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("ids"))

    def step(way: Column, place: Column) -> Column:
        # `next` counts down the letters of the piece the way is in; -1: no way on
        here = way["next"] == 0
        return (
            F.when(here & place.isNull(), F.struct(F.lit(-1).alias("next"), way["ids"].alias("ids")))
            .when(here, F.struct(
                (place["_letters"] - 1).alias("next"),
                F.array_append(way["ids"], place["piece_id"]).alias("ids")))
            .when(way["next"] > 0, F.struct((way["next"] - 1).alias("next"), way["ids"].alias("ids")))
            .otherwise(way)
        )

    unknown = F.array(F.lit(unknown_id))
    return F.aggregate(places, start, step,
                       lambda way: F.when(way["next"] == 0, way["ids"]).otherwise(unknown))


def with_vocabulary_ids(words: DataFrame, vocabulary: DataFrame, unknown_id: int,
                        token: str = "token", mark: str = MARK,
                        out: str = "piece_ids") -> DataFrame:
    """Add the ids of the pieces of each word.

    The pieces of the distinct words are written out, so that their measured size decides
    whether they are broadcast. An empty word has no pieces, a NULL word has NULL. With an empty vocabulary every word
    is unknown.
    """
    known = materialise(longest_matches(words, vocabulary, token, mark).select(
        F.col(token).alias("_word"), greedy_pieces(F.col("places"), unknown_id).alias(out)))
    joined = words.join(known, words[token] == known["_word"], "left").drop("_word")
    return joined.withColumn(out, F.when(F.col(token) == "", F.array().cast("array<int>"))
                             .otherwise(F.col(out)))
