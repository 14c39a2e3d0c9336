"""Documents that are out of the ordinary, and plain forms of what is computed."""

from __future__ import annotations

import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _id string, "
          "_row string, word string, bits string, score string, kept string, lines string")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
TEXTS = [
    (1, "Hello world this is a test.", "en", "src0"),
    (2, None, None, None),
    (3, "", "en", "src1"),
    (4, " \t\r\n ", "en", "src1"),
    (5, "Hello  world\tthis is\na test.", "en", "src0"),
    (None, "Hello world this is a test.", "en", "src0"),
    (7, LONG, "de", "src2"),
    (8, LONG + " more", "de", None),
    (9, "twice", "fr", "src7"),
    (9, "twice", "fr", "src7"),
    (9, "not the same", "fr", "src7"),
    (10, "123 456 !!!", "es", "src12"),
    (11, " ÄÖ ß 漢字 🙂 it's 'll  x", "xx", "srcx"),
    (12, "Hello world this is a test", "en", "src0"),
]


def rows(texts):
    return [(*row, None, *(["clash"] * 7)) for row in texts]


def tricky(spark):
    return spark.createDataFrame(rows(TEXTS), SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
