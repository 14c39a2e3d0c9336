"""Running values over a total order without putting the order into one task.

Rows are cut into chunks that follow the order. A window runs inside each chunk,
one row per chunk is summed up separately, and what the earlier chunks hold is
joined back. The full data is shuffled once, by chunk.

The borders of the chunks are quantiles of the order column, so the chunks hold about as
many rows each however the order is spread, and there are MAX_CHUNKS of them at most. What
the earlier chunks hold is a prefix scan over a tree: chunks are scanned within groups of
FANOUT, the groups are summed up to one row each, and these are scanned the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 1 << 18
# Rows of a partition of a shuffle by key, where there are more of them than this.
ROWS_PER_PART = 1 << 20
# A key with more rows than this is handled chunk by chunk, others in one group.
HOT_ROWS = 1 << 18

# Beyond this number of chunks they hold more rows each instead.
MAX_CHUNKS = 1 << 14
# Children of a node in the tree of chunk summaries.
FANOUT = 256
# Borders that are compared one by one; more are searched by halves.
FEW_BORDERS = 64

PRECEDING = (Window.unboundedPreceding, -1)
TO_CURRENT = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Chunks:
    """Pieces of an order, cut at ascending borders; a border belongs to the later piece.
    `rows_each` is about how many rows a piece holds."""

    borders: tuple[int, ...] = ()
    rows_each: int = ROWS_PER_CHUNK

    @property
    def count(self) -> int:
        return len(self.borders) + 1

    def of(self, order: Column) -> Column:
        """Number of the piece: how many borders are at or below it. NULL for NULL."""
        if len(self.borders) <= FEW_BORDERS:
            at_or_above = [(order >= F.lit(b)).cast("int") for b in self.borders]
            return sum(at_or_above, F.when(order.isNotNull(), F.lit(0)))
        borders = F.split(F.lit(",".join(map(str, self.borders))), ",").cast("array<bigint>")
        halves = F.lit([1 << i for i in reversed(range(len(self.borders).bit_length()))])

        def further(at: Column, step: Column) -> Column:
            there = (at + step <= len(self.borders)) & (F.get(borders, at + step - 1) <= order)
            return F.when(there, at + step).otherwise(at)

        return F.when(order.isNotNull(), F.aggregate(halves, F.lit(0), further))

    @property
    def parts(self) -> int:
        """Partitions that hold ROWS_PER_CHUNK rows each."""
        return -(-self.count // self._together)

    @property
    def _together(self) -> int:
        return max(1, ROWS_PER_CHUNK // self.rows_each)

    def part_of(self, chunk: Column) -> Column:
        """Number of the partition of a chunk, neighbours together; a NULL goes to the first."""
        first = F.coalesce(chunk, F.lit(0))
        return F.call_function("div", first, F.lit(self._together)).cast("int")


def order_chunks(rows: DataFrame, order: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> Chunks:
    """Chunks of about `rows_per_chunk` rows, by the quantiles of an integer order column.

    One aggregation over the column alone, or two beyond FANOUT chunks; what comes to the
    driver is bounded by MAX_CHUNKS. The borders are approximate: results do not depend on
    them, and any table whose order column is spread alike will do.
    """
    def quantiles(n: int) -> Column:
        return F.percentile_approx(order, [i / n for i in range(1, n)], 8 * n)

    found = rows.agg(F.count(order).alias("n"), quantiles(FANOUT).alias("borders")).first()
    n = min(-(-found["n"] // rows_per_chunk), MAX_CHUNKS)
    if n <= 1:
        return Chunks()
    rows_each = -(-found["n"] // n)
    if n <= FANOUT:
        return Chunks(tuple(sorted({found["borders"][i * FANOUT // n - 1] for i in range(1, n)})),
                      rows_each)
    return Chunks(tuple(sorted(set(rows.agg(quantiles(n)).first()[0]))), rows_each)


def by_chunks(rows: DataFrame, chunks: Chunks, order: Column) -> DataFrame:
    """Rows with the number of their `_chunk` and of their `_part`, dealt out by the latter.
    By the hash of their chunks they would lie unevenly, and a task of a larger table would
    hold more of them."""
    placed = rows.withColumn("_chunk", chunks.of(order))
    placed = placed.withColumn("_part", chunks.part_of(F.col("_chunk")))
    return placed.repartitionById(chunks.parts, "_part")


def by_keys(rows: DataFrame, keys: Sequence[str], n_rows: int) -> DataFrame:
    """Rows dealt out by `keys`, ROWS_PER_PART to a partition at most, for what comes next by
    these keys. What fits in one partition is left to Spark; of more rows it would put
    partitions together by their bytes, and small rows are many in these."""
    n = -(-n_rows // ROWS_PER_PART)
    if n <= 1:
        return rows
    spark = rows.sparkSession
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(n, min(few, spark.sparkContext.defaultParallelism)), *keys)


@dataclass(frozen=True)
class Running:
    """How values add up along an order: over a window, over a group by the number that
    orders it, and two parts, the earlier one first. NULL stands for nothing."""

    scan: Callable[[str], Column]
    total: Callable[[str, str], Column]
    joined: Callable[[Column, Column], Column]


SUM = Running(
    F.sum, lambda value, _: F.sum(value),
    lambda a, b: F.coalesce(a + b, a, b),
)
LAST = Running(
    lambda value: F.last(value, ignorenulls=True),
    lambda value, order: F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))),
    lambda a, b: F.coalesce(b, a),
)


def earlier_chunks(chunks: DataFrame, count: int, value: str, running: Running, out: str,
                   keys: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """(keys, _chunk, out): what the chunks before each chunk come to, per key.

    `chunks` has one row per key and chunk, whose number is below `count`, with its `value`.
    """
    cell = [*keys, "_chunk"]
    if count <= fanout:
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*PRECEDING)
        return chunks.select(*cell, running.scan(value).over(before).alias(out))
    placed = chunks.select(*cell, value, F.call_function(
        "div", F.col("_chunk"), F.lit(fanout)).cast("int").alias("_node"))
    nodes = placed.groupBy(*keys, "_node").agg(running.total(value, "_chunk").alias(value))
    above = earlier_chunks(nodes.withColumnRenamed("_node", "_chunk"), -(-count // fanout),
                           value, running, "_above", keys, fanout)
    before = Window.partitionBy(*keys, "_node").orderBy("_chunk").rowsBetween(*PRECEDING)
    within = placed.select(*cell, "_node", running.scan(value).over(before).alias("_within"))
    both = join_on(within, above.withColumnRenamed("_chunk", "_node"), [*keys, "_node"])
    return both.select(*cell, running.joined(F.col("_above"), F.col("_within")).alias(out))


def range_chunk(order: Column, rows: int = ROWS_PER_CHUNK) -> Column:
    """Chunk number of a near-dense integer order column."""
    return F.call_function("div", order, F.lit(rows))


def digest_chunk(digest: Column, rows: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> Column:
    """Chunk of a hex digest: as many leading digits as leave `rows_per_chunk` of `rows`
    at most in a chunk, on average. The rows are counted where the column is used."""
    digits = F.ceil(F.log(F.greatest(F.count("*"), F.lit(1)) / rows_per_chunk) / F.log(F.lit(16.0)))
    return F.substring(digest, F.lit(1), rows.agg(F.greatest(digits, F.lit(0)).cast("int")).scalar())


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that matches NULL with NULL."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(and_, [left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys])
    return left.join(right, same).drop(*[f"_right_{k}" for k in keys])


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[Column | str],
    chunk: Column,
    keys: Sequence[str] = (),
    out: str = "total",
    n_rows: int = 0,
) -> DataFrame:
    """Sum of `value` over all rows up to and including this one, per key. Where the number
    of rows is known, it decides on the number of partitions (see `by_keys`)."""
    cell = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    sums = rows.groupBy(*cell).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*PRECEDING)
    offsets = sums.select(*cell, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(*TO_CURRENT)
    rows = by_keys(rows, cell, n_rows)
    return (
        join_on(rows.withColumn(out, F.sum("_value").over(inside)), offsets, cell)
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_chunk", "_value", "_before")
    )


def number_rows(
    df: DataFrame,
    order: Sequence[Column | str],
    chunk: Column,
    keys: Sequence[str] = (),
    out: str = "row_no",
    n_rows: int = 0,
) -> DataFrame:
    """0-based row number in the given order, per key."""
    counted = running_total(df, F.lit(1).cast("long"), order, chunk, keys, out, n_rows)
    return counted.withColumn(out, F.col(out) - 1)


def long_records(words: DataFrame, record: str = "record_number", pos: str = "pos",
                 limit: int = HOT_ROWS) -> DataFrame:
    """Records that reach position `limit`, best taken from the stored word table,
    where the filter reaches the scan.

    Each of them has at least `limit` words, so this list is at most 1/limit of the
    rows, and for a table of titles it is empty.
    """
    return words.filter(F.col(pos) >= limit).select(record).distinct()


def split_long(words: DataFrame, long: DataFrame, record: str = "record_number"
               ) -> tuple[DataFrame, DataFrame]:
    """Words of ordinary and of long records."""
    return words.join(long, record, "left_anti"), words.join(long, record, "left_semi")
