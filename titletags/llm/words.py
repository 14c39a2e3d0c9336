"""Words of texts and how often they occur."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words a task counts before it hands its counts on.
COUNTED_AT_ONCE = 1 << 18
# Bytes of text whose words are held at once.
BYTES_AT_ONCE = 1 << 21


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as `words_of` finds them, and the place of each one's text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(words), 0)  # blanks at an end give empty words
    return words.filter(full), owner.filter(full).to_numpy().astype(np.int64)


def portions(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of `size` bytes at most, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64) + 1)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield start, stop
        start = stop


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) over all rows, words as UTF-8."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).group_by("word").aggregate([("c", "sum")])
        return found.rename_columns(["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, size = [], 0
        for batch in batches:
            texts = batch.column(0)
            for start, stop in portions(texts, BYTES_AT_ONCE):
                counts = split_words(texts.slice(start, stop - start))[0].value_counts()
                word, c = counts.flatten()
                tables.append(pa.table([word.cast(pa.binary()), c], ["word", "c"]))
                size += len(c)
                if size >= 2 * COUNTED_AT_ONCE:
                    tables = [summed(tables)]
                    size = len(tables[0])
                    if size >= COUNTED_AT_ONCE:
                        yield from tables[0].to_batches()
                        tables, size = [], 0
        if tables:
            yield from summed(tables).to_batches()

    return (
        docs.select(F.col(text).alias("_text")).mapInArrow(count, "word binary, c long")
        .groupBy("word").agg(F.sum("c").alias("c"))
    )


def most_frequent(counts: DataFrame, limit: int) -> pd.DataFrame:
    """(word, c) of the most frequent words of a written count, `limit` at most, the most
    frequent first. Words as frequent as the first one left out are left out too.

    The cut is found in a histogram of 16 steps per doubling, so nothing is sorted and no
    more than `limit` rows come to the driver.
    """
    step = F.floor(16 * F.log2("c")).cast("int")
    sizes = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    lowest, total = None, 0
    for row in sizes:  # about a thousand rows at most
        total += row["count"]
        if total > limit:
            break
        lowest = row["step"]
    chosen = counts.filter(F.lit(False) if lowest is None else step >= lowest)
    found = chosen.select("word", "c").toPandas()
    found["word"] = [bytes(w) for w in found["word"]]
    return found.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, tokens): rows a word stands in, and how often in all; the null word has
    the number of rows and of words."""

    def table(rows: Counter, tokens: Counter) -> pd.DataFrame:
        words = list(rows)
        return pd.DataFrame({"word": words, "n": [rows[w] for w in words],
                             "tokens": [tokens[w] for w in words]})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, tokens = Counter(), Counter()
        for batch in batches:
            for text in batch["_text"]:
                found = Counter(words_of(text))
                rows.update(found.keys())
                tokens.update(found)
                rows[None] += 1
                tokens[None] += found.total()
                if len(rows) >= COUNTED_AT_ONCE:
                    yield table(rows, tokens)
                    rows, tokens = Counter(), Counter()
        if rows:
            yield table(rows, tokens)

    return (
        docs.select(F.col(text).alias("_text"))
        .mapInPandas(count, "word binary, n long, tokens long")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    )
