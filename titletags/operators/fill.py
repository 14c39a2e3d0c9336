"""Fill in missing tags from the tag above."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titletags.functions.labels import as_inner
from titletags.operators.ordered import (
    LAST,
    ROWS_PER_CHUNK,
    TO_CURRENT,
    Chunks,
    by_chunks,
    earlier_chunks,
    join_on,
    order_chunks,
)


def forward_fill(
    df: DataFrame,
    tag: str = "tag",
    order: str = "row_idx",
    partition_by: Sequence[str] = (),
    inner: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    chunks: Chunks | None = None,
    placed: bool = False,
) -> DataFrame:
    """Replace each missing tag by the last tag above it in `order`.

    With `inner`, a filled row continues that tag: it gets the inner label. By
    default the fill runs over the whole table and crosses records, as the files
    mean it; `partition_by` restarts it per group. Rows above the first tag stay
    missing. A NULL key is a group of its own; a row without a place in the order passes
    nothing on.

    The order is worked off in chunks, whose last tags are carried on by a scan over the
    tree of chunks (see `ordered`). The borders of the chunks
    take an aggregation over the order column first; where `df` is costly to make, give
    `chunks` from a table whose order column is spread alike. With `placed`, `df` has been
    dealt out by these (`ordered.by_chunks`), for example before its rows were unfolded.
    """
    if chunks is None:
        chunks = order_chunks(df, order, rows_per_chunk)
    cell = held = [*partition_by, "_chunk"]
    if partition_by:
        rows = df.withColumn("_chunk", chunks.of(F.col(order)))
    else:
        rows = df if placed else by_chunks(df, chunks, F.col(order))
        held = ["_part", "_chunk"]
    inside = Window.partitionBy(*held).orderBy(order).rowsBetween(*TO_CURRENT)
    tagged_order = F.when(F.col(tag).isNotNull(), F.col(order))
    tails = rows.groupBy(*held).agg(F.max_by(tag, tagged_order).alias("_tail")).select(*cell, "_tail")
    if not partition_by:
        # A row per chunk; behind a shuffle they are made once for all levels of the tree.
        tails = tails.repartition(1)
    carried = earlier_chunks(tails, chunks.count, "_tail", LAST, "_carry", partition_by)
    if not partition_by:
        carried = F.broadcast(carried)  # a row per chunk, MAX_CHUNKS at most

    above = F.coalesce(F.col("_above"), F.col("_carry"))
    filled = as_inner(above) if inner else above
    return (
        join_on(rows.withColumn("_above", F.last(tag, ignorenulls=True).over(inside)), carried, cell)
        .withColumn(tag, F.coalesce(F.col(tag), filled))
        .select(*df.columns)
    )
