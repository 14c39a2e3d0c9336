"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, wanted: list[str], max_rows: int,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, the wanted labels) of at most `max_rows` labelled documents.

    Rows of `labels` with a null in a wanted column are left out. The sample is drawn
    by a hash of the id. Only the drawn ids, whose number is bounded, are broadcast.
    """
    draw = F.xxhash64(F.lit("sample"), F.col(doc_id).cast("string")).bitwiseAND(
        F.lit(2**63 - 1))
    known = labels.select(doc_id, *wanted).dropna().distinct()
    share = min(1.0, max_rows / max(known.count(), 1))
    # The share keeps what comes together in the limit small, the limit makes it certain.
    chosen = (
        known.withColumn("_draw", draw).filter(F.col("_draw") <= F.lit(share * 2.0**63))
        .orderBy("_draw", doc_id, *wanted).limit(max_rows)
    )
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen.select(F.col(doc_id).alias("doc_id"), *wanted)), "doc_id")
    )
