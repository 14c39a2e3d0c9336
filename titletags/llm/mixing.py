"""Mixing sources to target weights over a tree of domains, languages and sources.

Weights are handed down the tree: a node's budget is split among its children by their
weights. No child gets more than its documents hold in `max_epochs` epochs; what it
cannot use goes to its siblings by their weights, and only what all of them together
cannot use goes to the siblings of their parent. A leaf's documents are read in epochs,
each in an order of its own drawn from the seed; its budget is a prefix of the tokens
of that stream: some whole epochs, then a part of one more.

Scale: one scan counts tokens. The sums per leaf and per bucket of the drawn order are
made with map-side aggregation; only the one bucket per leaf in which the budget ends
is put in order, and buckets are made so small that their number follows the documents
of the leaf. Whether a document is taken is then a comparison with its leaf's cut, so
no document moves, and a source with a third of all rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletags.llm.common import WORD, written

NONE = "(none)"
DOCUMENTS_PER_BUCKET = 1 << 16
LEVELS = ("_domain", "_lang", "_source")


@dataclass(frozen=True)
class Mixture:
    """Target of a mix. `weights` maps a path, such as ("web", "en"), to a whole
    number; paths that are not named weigh `default_weight`. The budget is
    `budget_parts` out of `of_parts` of all tokens there are."""

    weights: Mapping[tuple[str, ...], int] = field(default_factory=dict)
    default_weight: int = 1
    budget_parts: int = 6
    of_parts: int = 10
    max_epochs: int = 4
    seed: int = 17


def tokens(text: str = "text") -> Column:
    """Words of a text; none of a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _leaf(domain: Column, lang: str, source: str) -> list[Column]:
    named = zip(LEVELS, (domain, F.col(lang), F.col(source)))
    return [F.coalesce(c.cast("string"), F.lit(NONE)).alias(name) for name, c in named]


def _weight(mixture: Mixture, depth: int) -> Column:
    named = {k: w for k, w in mixture.weights.items() if len(k) == depth}
    weight = F.lit(mixture.default_weight)
    for path, w in named.items():
        here = F.lit(True)
        for level, name in zip(LEVELS, path):
            here = here & (F.col(level) == name)
        weight = F.when(here, w).otherwise(weight)
    return weight.cast("long")


def share_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Split `_budget`, the same for all children of a parent, into `_given`.

    A child is full if its share of what the children before it left over, taken in the
    order of room per weight, is at least its `_room`. The others share the rest by
    weight; whole tokens are given so that the sum is exact.
    """
    siblings = Window.partitionBy(*parent)
    in_turn = siblings.orderBy((F.col("_room") / F.col("_weight")), name)
    before = in_turn.rowsBetween(Window.unboundedPreceding, -1)
    up_to = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("long")
    used_room = F.coalesce(F.sum("_room").over(before), zero)
    left_weight = F.sum("_weight").over(siblings) - F.coalesce(F.sum("_weight").over(before), zero)
    full = F.col("_room") * left_weight <= F.col("_weight") * (F.col("_budget") - used_room)
    open_weight = F.when(~F.col("_full"), F.col("_weight")).otherwise(zero)
    taken = F.when(F.col("_full"), F.col("_room")).otherwise(zero)
    marked = (
        nodes.withColumn("_room", F.when(F.col("_weight") > 0, F.col("_room")).otherwise(zero))
        .withColumn("_weight", F.greatest(F.col("_weight"), F.lit(1).cast("long")))
        .withColumn("_full", full)
        .withColumn("_rest", F.col("_budget") - F.sum(taken).over(siblings))
        .withColumn("_all", F.sum(open_weight).over(siblings))
        .withColumn("_upto", F.sum(open_weight).over(up_to))
    )

    def part(weight: Column) -> Column:
        return F.call_function("div", weight * F.col("_rest"), F.col("_all"))

    given = F.when(F.col("_full"), F.col("_room")).otherwise(
        part(F.col("_upto")) - part(F.col("_upto") - F.col("_weight")))
    return marked.withColumn("_given", given)


def _written_small(leaves: DataFrame) -> DataFrame:
    """A table of one row per leaf, in one file: many small ones would count as too large
    to be broadcast, and every document would be shuffled to the place of its leaf."""
    return written(leaves.repartition(1))


def leaf_budgets(counted: DataFrame, mixture: Mixture) -> DataFrame:
    """(levels, _docs, _supply, _given) per leaf."""
    leaves = counted.groupBy(*LEVELS).agg(
        F.count("*").alias("_docs"), F.sum("_tokens").alias("_supply"))
    leaves = _written_small(leaves)
    whole = leaves.agg(F.coalesce(F.sum("_supply"), F.lit(0)).alias("all")).first()["all"]
    nodes, parent = None, []
    for depth, level in enumerate(LEVELS, start=1):
        path = list(LEVELS[:depth])
        children = (
            leaves.groupBy(*path)
            .agg((F.sum("_supply") * mixture.max_epochs).alias("_room"))
            .withColumn("_weight", _weight(mixture, depth))
        )
        if nodes is None:
            budget = whole * mixture.budget_parts // mixture.of_parts
            children = children.withColumn("_budget", F.lit(budget).cast("long"))
        else:
            above = nodes.select(*parent, F.col("_given").alias("_budget"))
            children = children.join(above, parent)
        nodes, parent = share_out(children, parent, level), path
    return leaves.join(nodes.select(*LEVELS, "_given"), list(LEVELS))


def _digest(seed: int, doc_id: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("_epochs").cast("string"),
                             F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def cuts(counted: DataFrame, mixture: Mixture) -> DataFrame:
    """Per leaf: budget, whole epochs, and the last document of the epoch after them with
    its part (null if there is none). Documents with one digest follow by tokens and row."""
    budgets = leaf_budgets(counted, mixture)
    epochs = F.when(F.col("_supply") > 0, F.call_function("div", "_given", "_supply")).otherwise(0)
    digits = F.ceil(F.log(F.col("_docs") / DOCUMENTS_PER_BUCKET) / F.log(F.lit(16.0)))
    leaves = _written_small(
        budgets.withColumn("_epochs", epochs.cast("long"))
        .withColumn("_rest", F.col("_given") - F.col("_epochs") * F.col("_supply"))
        .withColumn("_digits", F.greatest(digits, F.lit(0)).cast("int"))
    )
    placed = (
        counted.join(leaves.filter(F.col("_rest") > 0), list(LEVELS))
        .withColumn("_digest", _digest(mixture.seed, "_id"))
        .withColumn("_bucket", F.substring("_digest", F.lit(1), F.col("_digits")))
    )
    in_leaf = Window.partitionBy(*LEVELS).orderBy("_bucket")
    ends = _written_small(
        placed.groupBy(*LEVELS, "_rest", "_bucket").agg(F.sum("_tokens").alias("_sum"))
        .withColumn("_end", F.sum("_sum").over(in_leaf))
        .filter((F.col("_end") >= F.col("_rest")) & (F.col("_end") - F.col("_sum") < F.col("_rest")))
        .select(*LEVELS, "_bucket", (F.col("_end") - F.col("_sum")).alias("_before"))
    )
    in_bucket = Window.partitionBy(*LEVELS).orderBy("_digest", "_tokens", "_n")
    last = (
        placed.join(ends, [*LEVELS, "_bucket"])
        .withColumn("_end", F.col("_before") + F.sum("_tokens").over(
            in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .filter(F.col("_end") >= F.col("_rest"))
        .groupBy(*LEVELS)
        .agg(F.min(F.struct("_digest", "_tokens", "_n", (F.col("_rest") - F.col("_end") + F.col("_tokens"))
                            .alias("part"))).alias("_last"))
    )
    return _written_small(
        leaves.join(last, list(LEVELS), "left")
        .select(*LEVELS, "_given", "_epochs", F.col("_last._digest").alias("_cut"),
                F.col("_last._tokens").alias("_cut_tokens"), F.col("_last._n").alias("_cut_n"),
                F.col("_last.part").alias("_part"))
    )


def _in_last_epoch(own_tokens: Column) -> Column:
    """Tokens of a document in the epoch that the budget ends in."""
    own = F.struct("_digest", own_tokens.alias("_tokens"), "_n")
    cut = F.struct(F.col("_cut").alias("_digest"), F.col("_cut_tokens").alias("_tokens"),
                   F.col("_cut_n").alias("_n"))
    return (
        F.when(F.col("_cut").isNull() | (own > cut), 0)
        .when(own < cut, own_tokens)
        .otherwise(F.least(own_tokens, F.col("_part")))
        .cast("long")
    )


def _counted(docs: DataFrame, domain: Column, doc_id: str, text: str, lang: str,
             source: str) -> DataFrame:
    return written(docs.select(F.col(doc_id).alias("_id"), *_leaf(domain, lang, source),
                               tokens(text).alias("_tokens"),
                               F.monotonically_increasing_id().alias("_n")))


def mix(docs: DataFrame, domain: Column, mixture: Mixture, doc_id: str = "doc_id",
        text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: doc_id, domain, lang, source, n_tokens, leaf_budget, epochs,
    last_epoch_tokens, tokens_taken.

    `epochs` is how often the document is read as a whole, `last_epoch_tokens` how many
    of its first tokens are read once more. A null level is a node of its own, shown as
    `(none)`. Null and empty texts have no tokens and cost nothing. Rows that repeat an
    id within a leaf follow one another, the shorter first, until the budget ends. A node of weight 0 gets nothing.
    An empty table gives an empty table. Other columns are not read.
    """
    counted = _counted(docs, domain, doc_id, text, lang, source)
    placed = counted.join(cuts(counted, mixture), list(LEVELS)).withColumn(
        "_digest", _digest(mixture.seed, "_id"))
    last = _in_last_epoch(F.col("_tokens"))
    return placed.select(
        F.col("_id").alias("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"),
        F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"),
        F.col("_given").alias("leaf_budget"), F.col("_epochs").alias("epochs"),
        last.alias("last_epoch_tokens"),
        (F.col("_epochs") * F.col("_tokens") + last).alias("tokens_taken"),
    )


def keep_mixed(docs: DataFrame, domain: Column, mixture: Mixture, doc_id: str = "doc_id",
               text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that the mix reads at least in part, each once, with all their
    columns. The document in which a budget ends is kept whole, and so are all rows
    of its leaf that share its id."""
    cut = cuts(_counted(docs, domain, doc_id, text, lang, source), mixture)
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"),
                       *_leaf(domain, lang, source))
    return (
        rows.join(cut, list(LEVELS))
        .withColumn("_digest", _digest(mixture.seed, "_id"))
        .filter((F.col("_epochs") > 0) | (F.col("_digest") <= F.col("_cut")))
        .select("_row.*")
    )
