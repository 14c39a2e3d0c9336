"""How filters interact: what each removes, in every order they can be applied in.

A row fails a filter by itself (a condition on its text) or because an earlier row has the
same text. The latter is an existential self-join: a left-semi join on the hash of the
text, the text and a smaller id. What fails it is put in union with what fails the others,
and rows are counted per combination of failures, as bits. All orders are then worked out
from these few counts.

Scale: a text is moved only if another one has its hash. The join finds one row per
different text on its right, however many copies there are, and a hash that very many rows
have is dealt to as many keys as it takes. Counts are taken per task before anything is
shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletags.llm.common import SPACES, written

# Rows of one hash that are joined under one key, on average.
ROWS_TOGETHER = 256


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D: few words, repeated words, capitals, signs."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(failures: dict[str, Column]) -> Column:
    return sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(failures.values())),
               F.lit(0))


def later_copies(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text is that of a row with a smaller id, with all their columns.

    A null id is neither smaller nor larger than another, so such rows are not among them.
    Texts are compared as they are; nulls are equal to none.
    """
    named = rows.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).withColumn(
        "_hash", F.xxhash64(text))
    repeated = written(
        named.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1")
        .select("_hash", F.ceil(F.col("_n") / ROWS_TOGETHER).alias("_keys")))
    suspects = written(named.join(repeated, "_hash").withColumn(
        "_key", F.monotonically_increasing_id() % F.col("_keys")))
    firsts = suspects.groupBy(F.col("_hash").alias("_same"), F.col(text).alias("_text")).agg(
        F.min(doc_id).alias("_first"), F.max("_keys").alias("_of"))
    firsts = firsts.withColumn("_each", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    copy = ((F.col("_hash") == F.col("_same")) & (F.col("_key") == F.col("_each"))
            & (F.col(text) == F.col("_text")) & (F.col("_first") < F.col(doc_id)))
    return suspects.join(firsts, copy, "left_semi").select(*rows.columns)


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang",
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, bits, n, good, toxic): rows per combination of failed filters, bit i for the
    ith of ABCDE, and how many of them are labelled good and toxic."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = ["doc_id", "part", "bits"]
    own = _bits(text_failures(F.col("text"))).alias("bits")
    all_rows = rows.select("doc_id", "part", own).withColumn("n", F.lit(1))
    copies = later_copies(rows).select("doc_id", "part", own)
    # A copy is taken from the rows that fail the other filters only, and put to those that
    # fail this one as well.
    moved = copies.select("doc_id", "part", F.explode(F.array(
        F.struct(F.col("bits"), F.lit(-1).alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(1 << 4)).alias("bits"), F.lit(1).alias("n")),
    )).alias("_to")).select("doc_id", "part", "_to.*")
    failed = all_rows.unionByName(moved).groupBy(*key).agg(F.sum("n").alias("n"))
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    known = failed.join(marked, "doc_id", "left").na.fill(0, ["good", "toxic"])
    return known.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
    ).filter("n > 0")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang",
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per part, order of the five filters and step: rows kept after it, removed by it,
    redundant (they fail its filter and are gone), unique_fails (they fail no other), good
    and toxic ones lost by it, and shapley, its filter's removals over all orders.

    A null part is the empty string, a null text is empty, and so are equal to those. Rows
    with a null or repeated id are rows of their own; a null id has no label and is no copy.
    Of several labels of an id one that says good, or toxic, is enough. Parts without rows
    are not there; an empty table gives an empty one. Other columns are not read.
    """
    letters = [*"ABCDE"]
    counts = failure_counts(docs, labels, part, doc_id, text).groupBy("part").agg(
        F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("_counts"))
    orders = F.array(*[F.lit("".join(o)) for o in permutations(letters)])
    steps = (
        counts.withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
        .withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
        .withColumn("_before", F.substring("filter_order", F.lit(1), F.col("step") - 1))
    )

    def bits(of: str) -> Column:
        return sum((F.when(F.instr(of, c) > 0, 1 << i).otherwise(0)
                    for i, c in enumerate(letters)), F.lit(0))

    def total(what: str, where) -> Column:
        return F.aggregate("_counts", F.lit(0).cast("long"), lambda a, c: a + F.when(
            where(c["bits"]), c[what]).otherwise(0))

    steps = steps.withColumn("_own", bits("letter")).withColumn("_earlier", bits("_before"))
    own, earlier = F.col("_own"), F.col("_earlier")

    def fails(found: Column, mask: Column) -> Column:
        return found.bitwiseAND(mask) != 0

    def here(found: Column) -> Column:
        return fails(found, own) & ~fails(found, earlier)

    worked = steps.select(
        "part", "filter_order", "step", "letter",
        total("n", lambda b: ~fails(b, own.bitwiseOR(earlier))).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda b: fails(b, own) & fails(b, earlier)).alias("redundant"),
        total("n", lambda b: b == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
    )
    all_orders = Window.partitionBy("part", "letter")
    return worked.withColumn("shapley", F.sum("removed").over(all_orders)).drop("letter")
