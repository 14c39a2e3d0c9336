"""Label lookups. The dictionary has a fixed 70 rows, so it is always broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titletags.functions.labels import label_dim


def _dim(df: DataFrame, *columns) -> DataFrame:
    return F.broadcast(label_dim(df.sparkSession).select(*columns))


def with_label_id(df: DataFrame, label: str = "label", out: str = "label_id",
                  how: str = "inner") -> DataFrame:
    """Label text to id. Unknown or missing labels drop out, or stay NULL with how='left'."""
    dim = _dim(df, F.col("label").alias(label), F.col("label_id").alias(out))
    return df.join(dim, label, how)


def with_label(df: DataFrame, label_id: str = "label_id", out: str = "label",
               how: str = "inner") -> DataFrame:
    """Label id to text."""
    dim = _dim(df, F.col("label_id").alias(label_id), F.col("label").alias(out))
    return df.join(dim, label_id, how)


def with_english(df: DataFrame, label: str = "label", out: str = "english") -> DataFrame:
    """English name of a label; NULL for inner labels and labels not in the dictionary."""
    dim = _dim(df, F.col("label").alias(label), F.col("english").alias(out))
    return df.join(dim, label, "left")
