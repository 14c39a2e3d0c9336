"""Near duplicates by SimHash fingerprints.

Fingerprints of 64 bits are cut into seven pieces. Two fingerprints that differ in at
most four bits agree in at least three whole pieces, so they meet under one of the 35
choices of three pieces: keys of 27 or 28 bits, under which few others meet. The
distance of all that meet is then checked, so no link is lost and none is wrong.

Only distinct fingerprints are linked. Under a key they are first compared with one
leader. Members that the leader's component holds are done with each other; only the
rest is compared with the others under its key. A large group of near copies thus costs
a row per member, not one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titletags.llm.common import merged, written
from titletags.llm.components import components

WORDS = 4
MAX_BITS = 4
SEED = 42
# Seven pieces of a fingerprint as (first bit, number of bits).
PIECES = ((0, 10), (10, 9), (19, 9), (28, 9), (37, 9), (46, 9), (55, 9))
KEY_PIECES = len(PIECES) - MAX_BITS


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of one text as a signed 64-bit number; 0 without words."""
    # bytes.lower and bytes.split know only A-Z and the six ASCII white spaces
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = max(1, len(tokens) - words + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        spans = zip(starts[:n].tolist(), ends[words - 1:].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans),
                             np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 words: int = WORDS) -> DataFrame:
    """(doc_id, bits) per row."""

    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    bits = F.pandas_udf(prints, "long")
    return docs.select(F.col(doc_id).alias("doc_id"), bits(F.col(text)).alias("bits"))


def _keys(bits: str) -> Column:
    """The keys of a fingerprint: number of the choice, and the chosen pieces."""
    keys = []
    for i, chosen in enumerate(combinations(PIECES, KEY_PIECES)):
        mask = sum(((1 << n) - 1) << first for first, n in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(i).cast("byte").alias("choice"),
                             F.col(bits).bitwiseAND(F.lit(signed).cast("long")).alias("part")))
    return F.array(*keys)


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def links(prints: DataFrame) -> DataFrame:
    """(a, b) edges between the distinct values of `bits` whose components are those of
    all pairs within MAX_BITS."""
    counted = prints.groupBy("bits").agg(F.count("*").alias("n"))
    keyed = counted.select("bits", "n", F.explode(_keys("bits")).alias("key")).select(
        "bits", "n", "key.*")
    # The leader is what most documents carry: most likely what the others were made from.
    leaders = (
        keyed.groupBy("choice", "part")
        .agg(F.count("*").alias("members"), F.max(F.struct("n", "bits"))["bits"].alias("leader"))
        .filter(F.col("members") > 1)
        .drop("members")
    )
    met = written(keyed.drop("n").join(merged(leaders), ["choice", "part"]))
    stars = written(
        met.filter((F.col("bits") != F.col("leader")) & _near("bits", "leader"))
        .select(F.col("bits").alias("a"), F.col("leader").alias("b")).distinct()
    )
    roots = components(stars)
    placed = written(
        met.drop("leader").join(roots.withColumnRenamed("node", "bits"), "bits", "left")
        .withColumn("root", F.coalesce("root", "bits"))
    )
    largest = (
        placed.groupBy("choice", "part", "root").agg(F.count("*").alias("size"))
        .groupBy("choice", "part")
        .agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count("*").alias("parts"))
        .filter(F.col("parts") > 1)
        .drop("parts")
    )
    # What is left to compare: under keys that hold several components so far.
    open_ = written(placed.join(merged(largest), ["choice", "part"]))
    minor = open_.filter(F.col("root") != F.col("main")).select(
        "choice", "part", F.col("bits").alias("a"), F.col("root").alias("root_a"))
    others = open_.select("choice", "part", F.col("bits").alias("b"), F.col("root").alias("root_b"))
    rest = (
        minor.join(merged(others), ["choice", "part"])
        .filter((F.col("root_a") != F.col("root_b")) & _near("a", "b"))
        .select("a", "b").distinct()
    )
    return stars.unionByName(rest)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    words: int = WORDS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id, component_size.

    Fingerprints are linked when they differ in at most four bits; component_id is the
    smallest id that can be reached over links. Null and empty texts and texts of white
    space have fingerprint zero, linked like any other. A text of fewer than `words`
    words is one shingle. Null ids are larger than all others. Repeated rows each get
    their row. An empty table gives an empty table. Other columns are not read.
    """
    return _placed(written(fingerprints(docs, doc_id, text, words)))


def _placed(prints: DataFrame) -> DataFrame:
    roots = components(links(prints))
    rooted = written(
        prints.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
        .join(roots.withColumnRenamed("node", "bits"), "bits", "left")
        .withColumn("root", F.coalesce("root", "bits"))
    )
    groups = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    classes = written(rooted.join(groups, "root")
                      .select("bits", "component_id", "component_size"))
    return prints.join(classes, "bits").select(
        "doc_id",
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        "component_id", "component_size",
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         words: int = WORDS) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each component,
    that with the smallest id. Of several rows with this id the first in the order of
    their fingerprints and then of all columns stays."""
    prints = written(fingerprints(docs, doc_id, text, words))
    placed = _placed(prints)
    stay = written(
        placed.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy(F.col("doc_id").alias("_id"), "component_id")
        .agg(F.min("fingerprint").alias("_print"), F.count("*").alias("_rows"))
    )
    whole = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"))

    def of(keys: DataFrame) -> DataFrame:
        on = F.col("a._id").eqNullSafe(F.col("b._id"))
        return whole.alias("a").join(keys.alias("b"), on, "left_semi")

    # Ids with one row in their component and in the table are the rule.
    rows = written(prints.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_all")))
    single = rows.filter(F.col("_all") == 1)
    on = F.col("a._id").eqNullSafe(F.col("b._id"))
    once = of(stay.alias("a").join(single.alias("b"), on, "left_semi")).select("_row.*")
    many = written(stay.alias("a").join(rows.filter(F.col("_all") > 1).alias("b"), on, "left_semi"))
    if many.isEmpty():
        return once
    repeated = of(many).select("_row.*")
    printed = repeated.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"),
                              F.col(text).alias("_text"))
    hexed = fingerprints(printed, "_row", "_text", words).select(
        F.col("doc_id").alias("_row"), F.col("doc_id")[doc_id].alias("_id"),
        F.lpad(F.lower(F.hex("bits")), 16, "0").alias("_print"))
    on = on & (F.col("a._print") == F.col("b._print"))
    first = (
        hexed.alias("a").join(many.alias("b"), on, "left_semi")
        .groupBy("_id", "_print").agg(F.min("_row").alias("_row")).select("_row.*")
    )
    return once.unionByName(first)
