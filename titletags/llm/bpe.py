"""Byte-level BPE: texts to token ids and back.

A text is cut by the tokenizer's pattern; each piece is encoded by itself. A segment
tree over the byte positions of a piece holds, for each token that is still alive, the
rank of the pair it forms with the next one; its root is the lowest rank and, among
equals, the leftmost place. A merge changes three leaves, so a piece of n bytes takes
O(n log n) steps, also where it has no space for a million bytes.

Scale: no shuffle; rows are encoded where they are read. The vocabulary is the only
thing that is broadcast; its size is that of the rank file, checked against
MAX_VOCABULARY_BYTES. Ids are kept as little-endian unsigned 32-bit integers in a
binary column, the form in which trainers read them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_VOCABULARY_BYTES = 1 << 25
# Pieces a Python worker remembers, twice: a full memory becomes the one of before, and
# what is met again moves on. Results do not depend on it.
REMEMBERED = 1 << 18
# Longer pieces are not remembered, so that the memory is bounded in bytes too.
REMEMBERED_CHARS = 64
# Characters of a text above which its pieces are made one after another.
AT_ONCE = 1 << 20
GONE = 1 << 62


class Tokenizer:
    """Ranks and pattern of one vocabulary, with what this process has encoded so far."""

    def __init__(self, rank_file: bytes, pattern: str):
        rows = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, bytes] = {}
        self.seen_before: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """Ids of the text, four bytes each."""
        if not text:
            return b""
        if len(text) <= AT_ONCE:
            return b"".join(map(self._piece, self.pattern.findall(text)))
        found = (m[0] for m in self.pattern.finditer(text))
        parts = []
        while pieces := list(islice(found, AT_ONCE)):
            parts.append(b"".join(map(self._piece, pieces)))
        return b"".join(parts)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for."""
        if not ids:
            return b""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _piece(self, piece: str) -> bytes:
        known = self.seen.get(piece)
        if known is None:
            known = self.seen_before.get(piece)
            if known is None:
                known = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.seen) >= REMEMBERED:
                    self.seen_before, self.seen = self.seen, {}
                self.seen[piece] = known
        return known


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of lowest rank until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # The token that starts at i ends at after[i], where the next one starts.
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    # Leaf n + i: rank and place of the pair that starts at i, as one number.
    tree = [GONE] * (2 * n)
    rank_of = ranks.get
    for i in range(n - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            tree[n + i] = (rank << 32) | i
    for at in range(n - 1, 0, -1):
        value, other = tree[2 * at], tree[2 * at + 1]
        tree[at] = value if value < other else other

    while (lowest := tree[1]) != GONE:
        start = lowest & 0xFFFFFFFF
        taken = after[start]
        end = after[start] = after[taken]
        changed = [(taken, GONE)]
        if end < n:
            before[end] = start
            rank = rank_of(piece[start:after[end]])
            changed.append((start, GONE if rank is None else (rank << 32) | start))
        else:
            changed.append((start, GONE))
        if start:
            left = before[start]
            rank = rank_of(piece[left:end])
            changed.append((left, GONE if rank is None else (rank << 32) | left))
        for leaf, value in changed:
            at = n + leaf
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:after[at]]])
        at = after[at]
    return out


@cache
def _tokenizer(rank_file: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(rank_file, pattern)


class Codec:
    """Column functions of one vocabulary; `path` is a rank file the driver can read."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as f:
            content = f.read()
        if len(content) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} is too large to be sent to every task")
        shared = spark.sparkContext.broadcast(content)

        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = _tokenizer(shared.value, pattern)
            for texts in batches:
                yield _series(map(tokenizer.encode, texts))

        def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = _tokenizer(shared.value, pattern)
            for ids in batches:
                yield _series(map(tokenizer.decode, ids))

        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            tokenizer = _tokenizer(shared.value, pattern)
            for texts in batches:
                ids = [tokenizer.encode(text) for text in texts]
                yield pd.DataFrame({"ids": ids, "decoded": [tokenizer.decode(i) for i in ids]})

        self._encode = F.pandas_udf(encoded, "binary")
        self._decode = F.pandas_udf(decoded, "binary")
        self._both = F.pandas_udf(both, "ids binary, decoded binary")

    def encode(self, text: Column) -> Column:
        """Ids of a text as a binary column; null and empty texts have no ids."""
        return self._encode(text)

    def round_trip(self, text: Column) -> Column:
        """Struct (ids, decoded): the ids, and the bytes that they decode to. One Python
        worker does both, where two columns would take two of them."""
        return self._both(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of the text that the ids stand for."""
        return self._decode(ids)


def _series(values: Iterable[bytes]) -> pd.Series:
    return pd.Series(list(values), dtype="object")


def encoded_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids, decoded (the bytes that the ids stand for).

    No special tokens. A null text counts as the empty text, which has no ids and
    decodes to no bytes. Repeated rows and null ids each get their row; an empty table
    gives an empty table; other columns are not read.
    """
    codec = Codec(docs.sparkSession, path, pattern)
    done = docs.select(F.col(doc_id).alias("doc_id"), codec.round_trip(F.col(text)).alias("_done"))
    ids = F.col("_done.ids")
    return done.select("doc_id", (F.length(ids) / 4).cast("long").alias("n_tokens"), ids,
                       "_done.decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded bytes."""
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
