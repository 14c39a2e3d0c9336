"""What the operators share: white space, null texts, label splits, written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.sources.tables import materialise

# White space of the contracts, as a Java and Python pattern: blank, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def id_remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal digits, modulo; a null id counts as the empty string."""
    digits = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return (F.crc32(digits.cast("binary")) % modulus).cast("int")


def written(rows: DataFrame) -> DataFrame:
    """End the lineage in a table of the shared folder, which outlives an executor."""
    return materialise(rows)


def merged(rows: DataFrame) -> DataFrame:
    """A side of a join that was unfolded from the corpus: met in a sorted merge, never
    broadcast. Spark sizes what is unfolded and then aggregated by the table below, however
    many rows come of it, and all of these would go to the driver."""
    return rows.hint("merge")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
