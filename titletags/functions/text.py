"""Words and word pieces as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character Unicode calls white space, as one regex class.
# Java's \s stops at ASCII, so a no-break space would stay inside a word.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

# Ids of the sequence start, padding and sequence end pieces.
CLS_ID, PAD_ID, SEP_ID = 0, 1, 2
FIRST_PIECE_ID = 3


def split_words(title: Column) -> Column:
    """White-space separated words of a title; an empty title has none."""
    # space at either end of the title leaves an empty first or last element
    return F.array_remove(F.split(title, SPACE), "")


def char_pieces(word: Column, width: int = 4) -> Column:
    """Stand-in tokenizer: pieces of up to `width` characters."""
    return F.regexp_extract_all(word, F.lit(".{1,%d}" % width), F.lit(0))


def piece_id(piece: Column) -> Column:
    """Stand-in vocabulary: a 16-bit hash of the piece, above the sentinel ids."""
    return F.conv(F.substring(F.md5(piece), 1, 4), 16, 10).cast("int") + FIRST_PIECE_ID


def char_piece_ids(word: Column, width: int = 4) -> Column:
    return F.transform(char_pieces(word, width), piece_id)


def shuffle_key(seed: int, *ids: Column) -> Column:
    """Hex digest that orders rows pseudo-randomly, the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))
