"""A keyed permutation of the numbers 0 to n - 1, computed row by row.

The swap-or-not shuffle (Hoang, Morris, Rogaway 2012): in each round a number has a partner,
`key - number` modulo n, and a bit of a hash of the larger of the two tells whether they
change places. A round is its own inverse, so any number of rounds is a permutation, for
every n, and no row has to know of another: nothing is sorted or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 32
# A prime below 2^31: products of two numbers below it fit a 64-bit number.
PRIME = 2147483647


def round_keys(seed: Column, n: Column, rounds: int = ROUNDS) -> Column:
    """Array of (key, factor, shift) per round, from digests of the seed and the round."""

    def digits(digest: Column, at: int, count: int) -> Column:
        return F.conv(F.substring(digest, at, count), 16, 10).cast("long")

    def keys(number: Column) -> Column:
        digest = F.md5(F.concat_ws(":", seed.cast("string"), number.cast("string")))
        return F.struct(
            (digits(digest, 1, 12) % n).alias("key"),
            (digits(digest, 13, 7) + 1).alias("factor"),
            digits(digest, 20, 7).alias("shift"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), keys)


def permuted(number: Column, n: Column, keys: Column) -> Column:
    """The place of `number`, which must be at least 0 and below n."""

    def swap(at: Column, key: Column) -> Column:
        partner = (key["key"] - at + n) % n
        larger = F.greatest(at, partner)
        # The middle digits: the lowest one of a product follows a short pattern.
        mixed = ((larger % PRIME) * key["factor"] + key["shift"]) % PRIME
        swaps = F.call_function("div", mixed, F.lit(65536)) % 2 == 1
        return F.when(swaps, partner).otherwise(at)

    return F.aggregate(keys, number.cast("long"), swap)
