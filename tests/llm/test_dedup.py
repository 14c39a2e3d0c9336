import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.cases import TEXTS, normalised, nothing, table, tricky, words
from titletags.llm.block_naming import drop_exact_duplicates, exact_duplicates
from titletags.llm.components import components
from titletags.llm.simhash import drop_near_duplicates, fingerprint, near_duplicates


@pytest.mark.parametrize("block_bytes", [512, 2048])
def test_exact_duplicates_of_tricky_documents(spark, block_bytes):
    groups = defaultdict(list)
    for doc_id, text, *_ in TEXTS:
        groups[normalised(text)].append(doc_id)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = True
        for i in ids:
            want.append((i, keep, len(ids), i == keep and left, digest))
            left = left and i != keep
    got = exact_duplicates(tricky(spark), block_bytes=block_bytes)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_drop_exact_duplicates_keeps_all_columns(spark):
    docs = tricky(spark)
    kept = drop_exact_duplicates(docs)
    assert kept.schema == docs.schema
    texts = [normalised(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normalised(t[1]) for t in TEXTS})


def test_blocks_that_share_a_digest_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from titletags.llm import block_naming

    rows = [(i, f"{'abc'[i % 3]}{i % 2}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = block_naming._blocks

    def colliding(keyed, size):
        return plain(keyed, size).withColumn("_h1", F.lit(0)).withColumn("_h2", F.lit(0))

    monkeypatch.setattr(block_naming, "_blocks", colliding)
    got = {r["doc_id"]: r["keep_id"] for r in exact_duplicates(docs).collect()}
    assert got == {i: i % 6 for i in range(12)}


def test_empty_tables(spark):
    assert exact_duplicates(nothing(spark)).count() == 0
    assert near_duplicates(nothing(spark)).count() == 0
    assert drop_exact_duplicates(nothing(spark)).count() == 0
    assert drop_near_duplicates(nothing(spark)).count() == 0


def brute_print(text):
    found = words(text)
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + 4]) for i in range(max(1, len(found) - 3))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for bit in range(64):
            ones[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(shingles))


def brute_components(prints):
    """prints: (id, fingerprint) rows; smallest id reachable, per row."""
    n = len(prints)
    values = np.array([p for _, p in prints], np.uint64)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            parent[find(i)] = find(int(j))
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            root = find(i)
            least[root] = min(least.get(root, doc_id), doc_id)
    return [least.get(find(i)) for i in range(n)]


def check_near(docs, texts):
    prints = [(i, brute_print(t)) for i, t in texts]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))]
    got = [tuple(r)[:3] for r in near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return want


def test_near_duplicates_of_tricky_documents(spark):
    check_near(tricky(spark), [row[:2] for row in TEXTS])


def test_near_duplicates_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir)
    want = check_near(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for *_, c in want})


def test_a_large_group_of_near_copies(spark):
    draw = random.Random(5)
    base = [f"t{draw.randrange(10**6)}" for _ in range(300)]
    texts = []
    for i in range(400):
        copy = list(base)
        for _ in range(draw.randrange(4)):
            copy[draw.randrange(len(copy))] = f"n{draw.randrange(10**6)}"
        texts.append((i, " ".join(copy)))
    check_near(spark.createDataFrame(texts, "doc_id long, text string"), texts)


def test_drop_near_duplicates_of_tricky_documents(spark):
    docs = tricky(spark)
    kept = drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    prints = [(row[0], brute_print(row[1])) for row in TEXTS]
    assert len(kept.collect()) == len(set(brute_components(prints)))


def test_fingerprints_of_long_texts():
    text = " ".join(f"a{i % 911}" for i in range(70_000))
    assert fingerprint(text) % (1 << 64) == brute_print(text)


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    edges += [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(90)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert set(roots) == linked and len(found) == len(linked)
    for a in linked:
        for b in linked:
            assert (roots[a] == roots[b]) == (find(a) == find(b))
