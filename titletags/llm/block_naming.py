"""Exact duplicates by block naming.

A text is cut into blocks of fixed size. The distinct blocks are sorted and numbered:
equal blocks have one name, different blocks different names. Then two adjacent names
are a pair, the distinct pairs are sorted and numbered, and so on until one name is
left for each text. Names are never hashes, so two texts have the same name exactly
if they are the same.

Scale: the text of each distinct block is shuffled once, after map-side aggregation;
afterwards only integers move, and their number halves from level to level. A group of
copies that holds much of the table adds one row per task to that aggregation, and is
met again only in joins with a written dictionary, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.llm.common import SPACES, written

BLOCK_BYTES = 2048
NO_PARTNER = -1
KEY = ["_id", "_k1", "_k2"]


def normalised(text: str = "text") -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Id, digest and UTF-8 bytes of each row. The digest only tells apart rows that
    share an id; it says nothing about equality of texts across ids."""
    return (
        docs.select(F.col(doc_id).alias("_id"), F.encode(normalised(text), "UTF-8").alias("_bytes"))
        .select("_id", F.xxhash64("_bytes").alias("_k1"),
                F.xxhash64(F.lit(1), "_bytes").alias("_k2"), "_bytes")
    )


def _blocks(keyed: DataFrame, size: int) -> DataFrame:
    n = F.greatest(F.ceil(F.length("_bytes") / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1),
                      lambda i: F.substring("_bytes", i * size + 1, F.lit(size)))
    return (
        keyed.select(*KEY, n.alias("_n"), F.posexplode(cut).alias("_pos", "_block"))
        .withColumn("_h1", F.xxhash64("_block"))
        .withColumn("_h2", F.xxhash64(F.lit(1), "_block"))
    )


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows, sorted, with an integer name each."""
    return distinct.sortWithinPartitions(*order).withColumn(
        "_name", F.monotonically_increasing_id())


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """One name per block of each text.

    The text is needed to tell the distinct blocks apart; a 128-bit digest then finds
    the name of a block without moving its text again. Should two different blocks
    share a digest, their text takes part in the lookup.
    """
    variants = blocks.groupBy("_h1", "_h2").agg(F.collect_set("_block").alias("_variants"))
    names = written(
        _numbered(
            variants.select("_h1", "_h2", (F.size("_variants") > 1).alias("_shared"),
                            F.explode("_variants").alias("_block")),
            ["_block"])
        .select("_h1", "_h2", "_name", F.when(F.col("_shared"), F.col("_block")).alias("_text"))
    )
    shared = names.filter(F.col("_text").isNotNull())
    on = ["_h1", "_h2"]
    if shared.isEmpty():
        return blocks.drop("_block").join(names.drop("_text"), on).drop(*on)
    clear = blocks.join(shared, on, "left_anti").drop("_block").join(names.drop("_text"), on)
    told = blocks.join(shared.withColumnRenamed("_text", "_block"), [*on, "_block"]).drop("_block")
    return clear.unionByName(told).drop(*on)


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_id, _k1, _k2, _level, _name) per distinct id and normalised text.

    Two texts are equal exactly if level and name are.
    """
    names = written(_name_blocks(_blocks(_keyed(docs, doc_id, text), block_bytes)))
    levels, level = [], 0
    while True:
        levels.append(names.filter(F.col("_n") == 1)
                      .select(*KEY, F.lit(level).alias("_level"), "_name").distinct())
        rest = names.filter(F.col("_n") > 1)
        if rest.isEmpty():
            break
        level += 1
        even = F.col("_pos") % 2 == 0
        pairs = written(
            rest.groupBy(*KEY, ((F.col("_n") + 1) / 2).cast("int").alias("_n"),
                         (F.col("_pos") / 2).cast("int").alias("_pos"))
            .agg(F.max(F.when(even, F.col("_name"))).alias("_left"),
                 F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(NO_PARTNER))
                 .alias("_right"))
        )
        dictionary = written(_numbered(pairs.select("_left", "_right").distinct(),
                                       ["_left", "_right"]))
        names = written(pairs.join(dictionary, ["_left", "_right"]).drop("_left", "_right"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _same(a: str, b: str) -> Column:
    keys = [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in KEY[1:]]
    return F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & keys[0] & keys[1]


def _grouped(docs: DataFrame, doc_id: str, text: str, block_bytes: int) -> DataFrame:
    """A row per distinct id and text: `_rows` of it, and its group."""
    ids = identities(docs, doc_id, text, block_bytes)
    rows = (
        _keyed(docs, doc_id, text)
        .groupBy(*KEY, F.sha2("_bytes", 256).alias("_sha"))
        .agg(F.count("*").alias("_rows"))
    )
    named = written(
        rows.alias("a").join(ids.alias("b"), _same("a", "b"))
        .select("a.*", "b._level", "b._name")
    )
    groups = written(
        named.groupBy("_level", "_name")
        .agg(F.min("_id").alias("_keep"), F.sum("_rows").alias("_size"))
    )
    return named.join(groups, ["_level", "_name"])


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after each run of white space became one space. In a group of
    equal texts the smallest id stays. A null text counts as the empty text, and empty
    texts form a group like any other. A null id is larger than every other id; it
    stays only if the group has no other. Of rows that repeat both id and text, one
    stays. An empty table gives an empty table. Other columns are not read.
    """
    found = _grouped(docs, doc_id, text, block_bytes)
    return (
        found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
        .select(
            F.col("_id").alias("doc_id"),
            F.col("_keep").alias("keep_id"),
            F.col("_size").alias("group_size"),
            (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_copy") == 1)).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    stay = (
        written(_grouped(docs, doc_id, text, block_bytes)
                .filter(F.col("_id").eqNullSafe(F.col("_keep"))).select(*KEY, "_rows"))
    )
    bytes_ = F.encode(normalised(text), "UTF-8")
    whole = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"),
                        F.xxhash64(bytes_).alias("_k1"), F.xxhash64(F.lit(1), bytes_).alias("_k2"))

    def of(keys: DataFrame) -> DataFrame:
        return whole.alias("a").join(keys.alias("b"), _same("a", "b"), "left_semi")

    once = of(stay.filter(F.col("_rows") == 1)).select("_row.*")
    many = stay.filter(F.col("_rows") > 1)
    if many.isEmpty():
        return once
    first = of(many).groupBy(*KEY).agg(F.min("_row").alias("_row")).select("_row.*")
    return once.unionByName(first)
