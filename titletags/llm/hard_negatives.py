"""Hard negatives: rows of another label that score nearly as well as a positive.

The score of two rows is the inner product of their vectors in whole numbers. Anchors and
candidates meet in tiles; the scores of a tile are one matrix product, taken by Strassen's
recursion: seven half-size products instead of eight, with zeros added where a side is odd.
Whole numbers make the additions exact, so the result is that of the plain product.

First each anchor's best rows of its own label are found, its positives. Then, for each
score of a positive, the best rows of other labels within the window below that score.
Both are heaps of fixed size that are merged tile after tile, and between tasks.

Scale: every anchor has to meet every row, in a grid of anchor blocks by candidate blocks.
A task holds one cell of the grid and sends on no more than a heap per anchor, so neither
a frequent label nor repeated rows make a task larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titletags.llm.common import written

ANCHORS = 512  # anchors of a cell
CANDIDATES = 8192  # candidates of a cell
TILE = 2048  # candidates of a product
LEAF = 16  # sides that are multiplied as they are
SCALE = 256.0

Heap = list[tuple]  # (-score, id is null, id), the best first


def _even(a: np.ndarray) -> np.ndarray:
    """Zeros added to make both sides even."""
    m, n = a.shape
    out = np.zeros((m + m % 2, n + n % 2), a.dtype)
    out[:m, :n] = a
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for whole numbers."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = _even(a), _even(b)
    (h, w), v = (a.shape[0] // 2, a.shape[1] // 2), b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :w], a[:h, w:], a[h:, :w], a[h:, w:]
    b11, b12, b21, b22 = b[:w, :v], b[:w, v:], b[w:, :v], b[w:, v:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])[:m, :n]


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """floor(SCALE * x) per component, rows filled up with zeros to `width`: 64-bit numbers,
    or Python's where these are too small."""
    lengths = np.asarray(vectors.value_lengths())
    found = np.floor(SCALE * np.asarray(vectors.flatten(), dtype=np.float64))
    if (np.abs(found) < 2.0**62).all():
        values = found.astype(np.int64)
    else:
        values = np.array([int(x) for x in found], dtype=object)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all rows of a with all rows of b. The largest score a hundred times over
    fits the 64-bit numbers used, else Python's are used."""
    if a.dtype != object and b.dtype != object:
        most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
        if 100 * most[0] * most[1] * max(a.shape[1], 1) < 2**63:
            return strassen(a, b.T)
    return strassen(a.astype(object), b.T.astype(object))


def best(scores: np.ndarray, allowed: np.ndarray, n: int, names: list[tuple]) -> list[Heap]:
    """Per row of scores the heap of its n best allowed columns. `names` are in the order
    in which ties come."""
    if not scores.size:
        return [[] for _ in scores]
    lowest = scores.min() - 1
    left = np.where(allowed, scores, lowest)
    heaps: list[Heap] = [[] for _ in scores]
    rows = np.arange(len(scores))
    for _ in range(n):
        at = left.argmax(axis=1)  # the first of equals
        top = left[rows, at]
        if not (top > lowest).any():
            break
        for i in np.flatnonzero(top > lowest):
            heaps[i].append((-int(top[i]), *names[at[i]]))
        left[rows, at] = lowest
    return heaps


def merge(a: Heap, b: Heap, n: int) -> Heap:
    return nsmallest(n, [*a, *b]) if a and b else a or b


class _Side:
    """The rows of a cell on one side, in the order of their ids, nulls last."""

    def __init__(self, rows: pa.Table, width: int):
        ids = rows["vec_id"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        rows = rows.take(pa.array(order, pa.int64()))
        self.names = [(ids[i] is None, ids[i] or 0) for i in order]
        self.row = rows["_row"].to_numpy()
        self.label = rows["label"].to_numpy()
        self.vectors = matrix(rows["vector"].combine_chunks(), width)


def _sides(anchors: pa.Table, candidates: pa.Table) -> tuple[_Side, _Side]:
    width = max((max(np.asarray(t["vector"].combine_chunks().value_lengths()), default=0)
                 for t in (anchors, candidates)), default=0)
    return _Side(anchors, width), _Side(candidates, width)


def _rows(found: dict[tuple, Heap], schema: pa.Schema) -> pa.Table:
    rows = [(*key, -entry[0], None if entry[1] else entry[2])
            for key, heap in found.items() for entry in heap]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                    [pa.array([], pa.int64()) for _ in schema.names], schema=schema)


_POSITIVE = "_anchor long, positive_score long, positive_id long"
_NEGATIVE = "_anchor long, positive_score long, negative_score long, negative_id long"


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64()) for c in columns.split(", ")])


def _positives_in_cell(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        heaps: dict[tuple, Heap] = {}
        if anchors.num_rows and candidates.num_rows:
            a, c = _sides(anchors, candidates)
            for label in np.intersect1d(a.label, c.label):
                own, all_ = np.flatnonzero(a.label == label), np.flatnonzero(c.label == label)
                for start in range(0, len(all_), TILE):
                    tile = all_[start:start + TILE]
                    others = a.row[own][:, None] != c.row[tile]
                    scores = products(a.vectors[own], c.vectors[tile])
                    names = [c.names[j] for j in tile]
                    for i, heap in zip(own, best(scores, others, n, names)):
                        key = (int(a.row[i]),)
                        heaps[key] = merge(heaps.get(key, []), heap, n)
        return _rows(heaps, _schema(_POSITIVE))

    return cell


def _negatives_in_cell(n: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cell(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        heaps: dict[tuple, Heap] = {}
        if anchors.num_rows and candidates.num_rows:
            a, c = _sides(anchors, candidates)
            order = {row: i for i, row in enumerate(anchors["_row"].to_pylist())}
            lists = anchors["scores"].to_pylist()
            wanted = [lists[order[int(row)]] for row in a.row]
            for start in range(0, len(c.row), TILE):
                tile = slice(start, start + TILE)
                scores = products(a.vectors, c.vectors[tile])
                different = a.label[:, None] != c.label[tile]
                for turn in range(max(map(len, wanted))):
                    rows = [i for i, scores_ in enumerate(wanted) if turn < len(scores_)]
                    score = np.array([[wanted[i][turn]] for i in rows], scores.dtype)
                    own = scores[rows]
                    within = different[rows] & (low * score <= 100 * own) & (
                        100 * own <= high * score)
                    for i, heap in zip(rows, best(own, within, n, c.names[tile])):
                        key = (int(a.row[i]), wanted[i][turn])
                        heaps[key] = merge(heaps.get(key, []), heap, n)
        return _rows(heaps, _schema(_NEGATIVE))

    return cell


def _grid(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_candidates: int,
          cell: Callable[[pa.Table, pa.Table], pa.Table], columns: str) -> DataFrame:
    """`cell` of each block of anchors with each block of candidates."""
    down, across = -(-n_anchors // ANCHORS) or 1, -(-n_candidates // CANDIDATES) or 1

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int):
        block = (F.monotonically_increasing_id() % n_own).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        blocks = rows.withColumn(own, block).withColumn(other, every)
        return blocks.toDF(*blocks.columns).groupBy("_down", "_across")  # columns of its own

    left = dealt(anchors, "_down", down, "_across", across)
    right = dealt(candidates, "_across", across, "_down", down)
    return left.cogroup(right).applyInArrow(cell, columns)


def _merged(heaps: DataFrame, key: list[str], score: str, name: str, n: int) -> DataFrame:
    """The heaps of all cells merged, with the rank in them. Spark cuts them down to n
    before it shuffles them."""
    order = Window.partitionBy(*key).orderBy(F.desc(score), F.asc_nulls_last(name))
    return heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def finite(vector: str) -> Column:
    """Whether a vector is there with all its components, none of them infinite or no number."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: (
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, vec_id: str = "vec_id",
                   vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that `anchor` holds for (a condition on vec_id and label), its best other
    rows of the same label are its positives; for each of them the best rows of another
    label that score from `low` to `high` percent of it. Higher scores come first, ties by
    the smaller id, null ids last.

    Rows with a null label or vector, or a component that is null or not finite, take no
    part. Repeated rows are rows of their own, as anchors too. Where vectors differ in
    length, the missing components count as zero. Few or no rows give few or none. A score
    that is no 64-bit number ends the job. Other columns are not read.
    """
    known = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(vector).alias("vector"),
    ).filter(F.col("label").isNotNull() & finite("vector"))
    known = written(known.withColumn("_row", F.monotonically_increasing_id())
                    .withColumn("_is_anchor", F.coalesce(anchor, F.lit(False))))
    n = known.agg(F.count("*").alias("rows"), F.count_if("_is_anchor").alias("anchors")).first()
    anchors, candidates = known.filter("_is_anchor").drop("_is_anchor"), known.drop("_is_anchor")

    near = _grid(anchors, candidates, n["anchors"], n["rows"], _positives_in_cell(positives), _POSITIVE)
    near = written(_merged(near, ["_anchor"], "positive_score", "positive_id", positives).drop("rank"))
    scores = near.groupBy(F.col("_anchor").alias("_row")).agg(
        F.collect_set("positive_score").alias("scores"))
    far = _grid(anchors.join(scores, "_row"), candidates, n["anchors"], n["rows"],
                _negatives_in_cell(negatives, low, high), _NEGATIVE)
    far = _merged(far, ["_anchor", "positive_score"], "negative_score", "negative_id", negatives)
    names = anchors.select(F.col("_row").alias("_anchor"), F.col("vec_id").alias("anchor_id"))
    return near.join(far, ["_anchor", "positive_score"]).join(names, "_anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
