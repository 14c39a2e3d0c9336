"""Between word tables and one sequence per record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletags.functions.labels import N_LABELS
from titletags.functions.text import split_words
from titletags.operators.ordered import (
    HOT_ROWS,
    number_rows,
    range_chunk,
    split_long,
)


def title_words(
    titles: DataFrame, title: str = "title", keep: tuple[str, ...] = ("record_number",)
) -> DataFrame:
    """One row per word of each title with its dense 0-based position."""
    words = title_words_in_context(titles, title, keep)
    return words.drop("prev", "next")


def title_words_in_context(
    titles: DataFrame, title: str = "title", keep: tuple[str, ...] = ("record_number",)
) -> DataFrame:
    """`title_words` with the neighbouring words, read from the title itself: no shuffle."""
    words = titles.select(*keep, split_words(F.col(title)).alias("_words"))
    # The outer form keeps the optimizer from testing the array first, which would
    # split every title twice more; titles without words are dropped right after.
    exploded = words.select(*keep, "_words", F.posexplode_outer("_words").alias("pos", "token"))
    return exploded.filter(F.col("pos").isNotNull()).select(
        *keep, "pos", "token",
        F.get("_words", F.col("pos") - 1).alias("prev"),
        F.get("_words", F.col("pos") + 1).alias("next"),
    )


def word_sequences(
    words: DataFrame,
    values: Column | None = None,
    record: str = "record_number",
    pos: str = "pos",
    part_words: int | None = None,
    place: Sequence[str] = (),
) -> DataFrame:
    """The words of a record as one ordered array of structs, `seq`.

    Each struct starts with the position; `values` is a struct of the other
    fields (default: token and tag). A record is one row, part 0, whatever its length;
    with `part_words` it becomes a row per so many positions, told apart by `part`, for
    uses that can do with pieces of a record. `place` names columns by which the words lie
    dealt out and of which no record has two values; they are gathered where they lie then.
    """
    values = F.struct("token", "tag") if values is None else values
    part = F.lit(0) if part_words is None else F.call_function("div", F.col(pos), F.lit(part_words))
    return (
        words.withColumn("part", part.cast("int"))
        .groupBy(record, "part", *place)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), values.alias("v"))))
             .alias("seq"))
        .drop(*place)
    )


def sequence_words(sequences: DataFrame, record: str = "record_number") -> DataFrame:
    """Inverse of `word_sequences`."""
    return sequences.select(record, F.inline("seq")).select(record, "pos", "v.*")


def dense_positions(
    words: DataFrame, record: str = "record_number", order: str = "row_idx", out: str = "pos"
) -> DataFrame:
    """0-based position of each word in its record, from any unique integer order.

    Records with more than HOT_ROWS words are found by count, at most one per HOT_ROWS
    input rows, and numbered chunk by chunk.
    """
    rows = words.drop(out) if out != order else words.withColumnRenamed(order, "_order")
    by = order if out != order else "_order"
    hot = words.groupBy(record).count().filter(F.col("count") > HOT_ROWS).select(record)
    w = Window.partitionBy(record).orderBy(by)
    plain = rows.join(hot, record, "left_anti").withColumn(
        out, (F.row_number().over(w) - 1).cast("long")
    )
    long = number_rows(rows.join(hot, record, "left_semi"), [by], range_chunk(F.col(by)),
                       keys=[record], out=out)
    return plain.unionByName(long).drop("_order")


def with_neighbours(
    words: DataFrame, record: str = "record_number", pos: str = "pos", token: str = "token",
    long: DataFrame | None = None, place: Sequence[str] = (),
) -> DataFrame:
    """Previous and next word of the same record, from a word table.

    Words of the records in `long` (see `ordered.long_records`) are numbered chunk
    by chunk and meet their neighbours through joins on a unique key. `place` names columns
    by which the words lie dealt out and of which no record has two values; they meet their
    neighbours where they lie then.
    """

    def windowed(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*place, record).orderBy(pos)
        return rows.withColumns({"prev": F.lag(token).over(w), "next": F.lead(token).over(w)})

    if long is None:
        return windowed(words)
    plain, rest = split_long(words, long, record)
    # The chunks they are numbered by are not those of their place.
    kept = {c: f"_of{c}" for c in place}
    numbered = number_rows(rest.withColumnsRenamed(kept), [pos], range_chunk(F.col(pos)),
                           keys=[record], out="_i")
    numbered = numbered.withColumnsRenamed({b: a for a, b in kept.items()})
    prev = numbered.select(record, (F.col("_i") + 1).alias("_i"), F.col(token).alias("prev"))
    nxt = numbered.select(record, (F.col("_i") - 1).alias("_i"), F.col(token).alias("next"))
    joined = numbered.join(prev, [record, "_i"], "left").join(nxt, [record, "_i"], "left")
    return windowed(plain).unionByName(joined.drop("_i"))


def first_titles(words: DataFrame, record: str = "record_number", title: str = "title",
                 order: str = "row_idx") -> DataFrame:
    """Title on the first row of each record."""
    return words.groupBy(record).agg(F.min_by(title, order).alias(title))


def distinct_tags(words: DataFrame, record: str = "record_number", tag: str = "tag",
                  order: str = "row_idx") -> DataFrame:
    """Distinct tags of each record in order of first appearance.

    Reduced to one row per (record, tag) first, so the collected arrays are no
    longer than the label dictionary.
    """
    firsts = words.groupBy(record, tag).agg(F.min(order).alias("_first"))
    return firsts.groupBy(record).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_first", tag))), lambda x: x[tag]
        ).alias("tags")
    )


def tag_index(words: DataFrame, tag: str = "tag", order: str = "row_idx") -> DataFrame:
    """Distinct tags of the table, numbered from 0 by first appearance."""
    firsts = words.groupBy(tag).agg(F.min(order).alias("first_idx"))
    return number_rows(firsts, ["first_idx"], range_chunk(F.col("first_idx")), out="tag_no")


def multi_hot(words: DataFrame, record: str = "record_number", label_id: str = "label_id",
              width: int = N_LABELS) -> DataFrame:
    """0/1 vector per record over all label ids; missing labels are left out.

    The ids are gathered as bits of whole numbers, so the aggregation buffer has a
    fixed width and stays in a hash table.
    """
    bits = 63
    words_needed = range(-(-width // bits))
    gathered = words.groupBy(record).agg(*[
        F.bit_or(
            F.when(
                F.floor(F.col(label_id) / bits) == w,
                F.call_function("shiftleft", F.lit(1).cast("long"), F.col(label_id) % bits),
            )
        ).alias(f"_bits{w}")
        for w in words_needed
    ])
    hot = [
        F.coalesce(F.getbit(f"_bits{i // bits}", F.lit(i % bits)).cast("int"), F.lit(0))
        for i in range(width)
    ]
    return gathered.select(record, F.array(*hot).alias("hot"))


def multi_hot_columns(words: DataFrame, tags: list[str], record: str = "record_number",
                      tag: str = "tag") -> DataFrame:
    """One 0/1 column per given tag."""
    return words.groupBy(record).agg(
        *[F.max((F.col(tag).eqNullSafe(t)).cast("int")).alias(t) for t in tags]
    )


def tag_frequency(words: DataFrame, tag: str = "tag") -> DataFrame:
    """Row count per tag, missing tags left out; most frequent first, ties by tag."""
    return (
        words.filter(F.col(tag).isNotNull())
        .groupBy(tag)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), tag)
    )


def sequence_check(titles: DataFrame, words: DataFrame, record: str = "record_number",
                   title: str = "title", label: str = "tag") -> DataFrame:
    """Words in the title, tagged words and labelled words per record, with a verdict."""
    counted = words.groupBy(record).agg(
        F.count("*").alias("n_tags"), F.count(label).alias("n_labelled")
    )
    sizes = titles.select(record, F.size(split_words(F.col(title))).cast("long").alias("n_words"))
    both = sizes.join(counted, record, "full_outer").fillna(0, ["n_words", "n_tags", "n_labelled"])
    return both.withColumn(
        "problem",
        F.when(F.col("n_words") != F.col("n_tags"), "words and tags differ")
        .when(F.col("n_labelled") != F.col("n_tags"), "words without a tag"),
    )
