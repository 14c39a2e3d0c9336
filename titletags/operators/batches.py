"""Fixed-size batches: shuffle, cut, pad, repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletags.functions.text import PAD_ID, shuffle_key
from titletags.operators.ordered import ROWS_PER_CHUNK, digest_chunk, number_rows, range_chunk
from titletags.operators.permutation import permuted, round_keys

BATCH_SIZE = 32


def batches_in_order(rows: DataFrame, order: str, size: int = BATCH_SIZE,
                     rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Cut rows in the order of a near-dense integer column: `batch_id`, `slot`."""
    numbered = number_rows(rows, [order], range_chunk(F.col(order), rows_per_chunk), out="_n")
    return _cut(numbered, size).drop("_n")


def batches_shuffled(rows: DataFrame, seed: int, record: str = "record_number",
                     size: int = BATCH_SIZE) -> DataFrame:
    """Cut rows in a seeded random order of the unique column `record`.

    Only the keys are numbered; give a written table where rows are costly to make.
    """
    keys = rows.select(record).withColumn("_digest", shuffle_key(seed, F.col(record)))
    numbered = number_rows(keys, ["_digest", record], digest_chunk(F.col("_digest"), rows), out="_n")
    return rows.join(_cut(numbered, size).drop("_n", "_digest"), record)


def _cut(numbered: DataFrame, size: int) -> DataFrame:
    n = F.col("_n")
    return numbered.withColumn("batch_id", F.call_function("div", n, F.lit(size))).withColumn(
        "slot", (n % size).cast("int")
    )


def pad_batches(batches: DataFrame, pad_id: int = PAD_ID, batch: str = "batch_id") -> DataFrame:
    """Pad `ids` and `labels` to the longest row of the batch and add the mask.

    Labels are padded with NULL. A window per batch holds one batch, so it is small.
    """
    longest = F.max(F.size("ids")).over(Window.partitionBy(batch))
    padded = batches.withColumn("_pad", longest - F.size("ids"))
    ids = F.concat("ids", F.array_repeat(F.lit(pad_id), F.col("_pad")))
    labels = F.concat("labels", F.array_repeat(F.lit(None).cast("int"), F.col("_pad")))
    return (
        padded.withColumns({"ids": ids, "labels": labels})
        .withColumn("mask", attention_mask(F.col("ids"), pad_id))
        .drop("_pad")
    )


def attention_mask(ids: Column, pad_id: int = PAD_ID) -> Column:
    return F.transform(ids, lambda i: (i != pad_id).cast("int"))


def cycle_permuted(rows: DataFrame, num_steps: int, seed: int, number: str = "row_idx",
                   size: int = BATCH_SIZE) -> DataFrame:
    """Exactly `num_steps` batches, `step` 0 onwards, in another order on each new pass.

    `number` must number the rows from 0 without gaps, as the readers of `sources.tables`
    do. Pass i takes them in the order of a keyed permutation of seed + i (see
    `permutation`), which each row works out by itself, so a pass is neither sorted nor
    shuffled; the number of rows is a scalar subquery, give a written table. No rows, or no
    steps, give no batches. `cycle_batches` needs no row numbers, and sorts.
    """
    one = rows.agg(F.nullif(F.count("*"), F.lit(0)).alias("n"))
    one = one.withColumn("per_pass", F.call_function("div", F.col("n") + (size - 1), F.lit(size)))
    last = F.call_function("div", F.lit(num_steps) - 1, F.col("per_pass"))
    passes = F.sequence(F.lit(0).cast("long"), last)
    # The keys of all passes are worked out once, not for each row.
    sizes = one.select(F.struct("n", "per_pass", last.alias("last"), F.transform(
        passes, lambda i: round_keys(F.lit(seed) + i, F.col("n"))).alias("keys"))).scalar()
    sized = rows.filter(F.lit(num_steps > 0)).withColumn("_sizes", sizes)
    repeated = sized.withColumn("pass_no", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("_sizes.last")))).withColumn(
        "_per_pass", F.col("_sizes.per_pass"))
    place = permuted(F.col(number), F.col("_sizes.n"),
                     F.get("_sizes.keys", F.col("pass_no").cast("int")))
    placed = repeated.withColumn("_at", place)
    at = F.col("_at")
    step = F.col("pass_no") * F.col("_per_pass") + F.call_function("div", at, F.lit(size))
    return (
        placed.withColumn("step", step).withColumn("slot", (at % size).cast("int"))
        .filter(F.col("step") < num_steps)
        .drop("_sizes", "_per_pass", "_at")
    )


def cycle_batches(rows: DataFrame, num_steps: int, seed: int, record: str = "record_number",
                  size: int = BATCH_SIZE) -> DataFrame:
    """Exactly `num_steps` batches, `step` 0 onwards, reshuffled on each new pass.

    Pass i orders the rows by seed + i. Keys are repeated once per pass that is begun,
    rows only for the batches that are kept; the number of batches in a pass is a scalar
    subquery.
    """
    per_pass = rows.agg(F.ceil(F.count("*") / size).cast("long").alias("n")).scalar()
    passes = F.sequence(F.lit(0).cast("long"), F.floor((F.lit(num_steps) - 1) / per_pass))
    keys = rows.select(record).withColumn("per_pass", per_pass)
    repeated = keys.withColumn("pass_no", F.explode(passes))
    digest = F.md5(F.concat_ws(":", F.lit(seed) + F.col("pass_no"), F.col(record)))
    numbered = number_rows(
        repeated.withColumn("_digest", digest), ["_digest", record],
        digest_chunk(F.col("_digest"), rows), keys=["pass_no"], out="_n",
    )
    steps = _cut(numbered, size).withColumn(
        "step", F.col("pass_no") * F.col("per_pass") + F.col("batch_id")
    )
    kept = steps.filter(F.col("step") < num_steps).drop("_n", "_digest", "per_pass")
    return rows.join(kept, record)
