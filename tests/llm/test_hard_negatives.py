"""Hard negatives, against all pairs in Python's numbers."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import table
from titletags.llm import hard_negatives as module
from titletags.llm.hard_negatives import hard_negatives, matrix, products, strassen
from titletags.llm.queries import QUERIES

SCHEMA = "vec_id long, label int, embedding array<double>, _row string, scores string, vector int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, is_anchor, positives=5, negatives=3):
    """rows: (vec_id, label, vector)."""
    known = [
        (i, label, [math.floor(256 * x) for x in vector]) for i, label, vector in rows
        if label is not None and vector is not None
        and all(x is not None and math.isfinite(x) for x in vector)
    ]

    def order(found):
        return sorted(found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))

    out = []
    for at, (anchor, label, vector) in enumerate(known):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(sum(map(int.__mul__, vector, other)), i, same == label)
                  for j, (i, same, other) in enumerate(known) if j != at]
        for p, positive, _ in order([s for s in scored if s[2]])[:positives]:
            window = [s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(anchor, positive, rank, i, p, score)
                    for rank, (score, i, _) in enumerate(order(window)[:negatives], 1)]
    return out


def key(row):
    return tuple((v is None, v or 0) for v in row)


def same(found, want):
    got = [tuple(r[c] for c in COLUMNS) for r in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 3), (33, 64, 70), (130, 65, 31)])
def test_strassen_is_the_plain_product(shape):
    m, k, n = shape
    draw = np.random.default_rng(0)
    a, b = draw.integers(-10**6, 10**6, (m, k)), draw.integers(-10**6, 10**6, (k, n))
    for leaf in (1, 4, 32):
        assert (strassen(a, b, leaf) == a @ b).all()
    large = a.astype(object) * 10**20
    assert (strassen(large, b.astype(object), 8) == large @ b.astype(object)).all()


def test_numbers_too_large_for_64_bits():
    vectors = pa.array([[1e30, -0.001, 2.0], [3.5]], pa.list_(pa.float64()))
    found = matrix(vectors, 4)
    assert found.tolist() == [[int(256e30), -1, 512, 0], [896, 0, 0, 0]]
    assert products(found, found)[0, 0] == int(256e30) ** 2 + 1 + 512**2
    near = np.full((1, 4), 2**31)
    assert products(near, near)[0, 0] == 2**64


def test_embeddings(spark, sf_dir):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"],
             r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    found = QUERIES["op12_hard_negatives"](spark, sf_dir)
    assert dict(found.dtypes) == {c: "int" if c == "rank" else "bigint" for c in COLUMNS}
    same(found, brute(rows, lambda i: i % 50 == 0))


def test_small_cells_give_the_same(spark, sf_dir, monkeypatch):
    for name, size in (("ANCHORS", 3), ("CANDIDATES", 90), ("TILE", 40), ("LEAF", 4)):
        monkeypatch.setattr(module, name, size)
    rows = table(spark, sf_dir, "embeddings").filter("vec_id < 300")
    plain = [(r["vec_id"], r["label"], r["embedding"]) for r in rows.collect()]
    same(hard_negatives(rows, F.col("vec_id") % 20 == 0), brute(plain, lambda i: i % 20 == 0))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [2.0, 2.0]), (50, 1, [2.0, 1.0, 9.0]),
        (None, 1, [1.0, 2.0]), (None, 2, [0.9, 1.0]), (3, None, [1.0, 1.0]), (4, 1, None),
        (5, 1, [1.0, None]), (6, 1, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, []), (9, 2, [1.0]),
        (10, 2, [0.5, 1.5]), (11, 2, [0.5, 1.5]), (11, 2, [0.5, 1.5]), (12, 1, [-1.0, -1.0]),
        (100, 3, [0.0, 0.0]), (101, 3, [0.0, 0.0]), (150, 4, [1.0, 1.0]),
    ]
    data = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], SCHEMA)
    # Shorter vectors go on with zeros.
    wide = [(i, label, v and [*v, *[0.0] * (3 - len(v))]) for i, label, v in rows]
    wide[11] = (8, 2, [0.0] * 3)
    want = brute(wide, lambda i: i % 50 == 0)
    assert want and any(r[3] is None for r in want) and any(r[1] is None for r in want)
    same(hard_negatives(data, F.col("vec_id") % 50 == 0), want)
    assert hard_negatives(data.filter("false"), F.lit(True)).count() == 0
    assert hard_negatives(data, F.lit(False)).count() == 0


def test_ties_and_many_repeated_rows(spark):
    rows = [(i % 7, i % 2, [1.0 + (i % 3) / 4, 1.0]) for i in range(400)]
    data = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    same(hard_negatives(data, F.col("vec_id") == 0), brute(rows, lambda i: i == 0))
