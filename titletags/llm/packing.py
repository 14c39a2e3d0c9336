"""Token sequences of a fixed capacity, packed from documents.

Documents are cut into pieces of at most the capacity. How many sequences of which make-up
hold all pieces depends on the number of pieces of each length only, and there are no more
lengths than the capacity. So Spark counts the lengths, the plan is made from that bounded
histogram, and Spark gives each piece its place.

The plan is made in two steps. Best fit, longest pieces first, puts each piece where least
room is left; sequences that are filled alike are one class with a count, so a step fills
all of them at once. Then a local search goes over the classes that are not full: it moves
a piece, exchanges one for one, or two for one, from an emptier sequence into a fuller one.
Each exchange raises the sum of the squared fills, and drains the emptiest sequences until
they vanish. It ends when there are provably no fewer sequences, or nothing to exchange.

Scale: pieces of a length are numbered within the task that cut them, and a table of counts
by (length, task) numbers them overall, so a length that a third of all pieces have is like
any other. No more than one row per length comes to the driver. The plan has at most some
three classes per length, each with no more different lengths than sum up to the capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titletags.llm.word_pieces import shared_encoder
from titletags.operators.ordered import PRECEDING

CAPACITY = 4096
# Pairs of classes the local search looks at, at most. The packing is whole at any number.
TRIALS = 5_000
# Bytes of ids a task gathers before it hands them on.
BATCH_BYTES = 1 << 22

Items = tuple[tuple[int, int], ...]  # (length, how many), longest first

PIECES = ("doc_id long, piece int, start long, length long, ids binary, "
          "part long, nth long")


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of the token ids of each document, its end id included.

    (doc_id, piece, start, length, ids, part, nth): ids are unsigned 32-bit numbers, lowest
    byte first; `nth` numbers the pieces of a length within the task `part`, so write the
    pieces before they are packed. Null and empty texts are the end id alone. Rows with a
    null or repeated id are documents of their own; an empty table has no pieces. Other
    columns are not read.
    """
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = shared_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            taken, rows, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                ids = encoder.encode(text.as_py()) + last
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + capacity)]
                    length = len(own) // 4
                    taken.append(i)
                    rows.append((piece, start, length, own, part, int(seen[length])))
                    seen[length] += 1
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield table(batch.column(0), taken, rows)
                    taken, rows, size = [], [], 0
            if rows:
                yield table(batch.column(0), taken, rows)

    def table(ids: pa.Array, taken: list[int], rows: list[tuple]) -> pa.RecordBatch:
        piece, start, length, data, part, nth = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(taken)), pa.array(piece, pa.int32()),
             pa.array(start, pa.int64()), pa.array(length, pa.int64()),
             pa.array(data, pa.binary()), pa.array(part, pa.int64()), pa.array(nth, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: dict[int, int], capacity: int) -> Counter[Items]:
    """Sequences by make-up: pieces from the longest to the shortest, each where least room
    is left. `lengths` has the number of pieces of each length."""
    classes: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]
    room = 0  # bit r: some sequence has room for r more

    def put(count: int, chain: tuple, left: int) -> int:
        classes[left].append((count, chain))
        return room | 1 << left

    for length in sorted(lengths, reverse=True):
        pieces = lengths[length]
        while pieces:
            fitting = room >> length << length
            if fitting:
                left = (fitting & -fitting).bit_length() - 1
                count, chain = classes[left].pop()
                if not classes[left]:
                    room ^= 1 << left
            else:  # new sequences, as many as are wanted
                left, count, chain = capacity, pieces, ()
            each = left // length
            full = min(count, pieces // each)
            if full:
                room = put(full, (*chain, (length, each)), left - each * length)
                pieces -= full * each
                count -= full
            if count and pieces:  # the last one takes what there is
                room = put(1, (*chain, (length, pieces)), left - pieces * length)
                pieces, count = 0, count - 1
            if count and chain:
                room = put(count, chain, left)
    found: Counter[Items] = Counter()
    for entries in classes:
        for count, chain in entries:
            found[chain] += count
    return found


def fewest(lengths: dict[int, int], capacity: int) -> int:
    """A number of sequences below which no packing can go.

    For a limit, pieces beyond capacity - limit stand alone, those beyond half the capacity
    one to a sequence, and the pieces from the limit to the half have only the room that
    the latter leave (Martello and Toth's second bound).
    """
    count = np.zeros(capacity + 2, np.int64)
    for length, n in lengths.items():
        count[length] += n
    number, tokens = np.cumsum(count), np.cumsum(count * np.arange(capacity + 2))
    half, best = capacity // 2, -(-int(tokens[-1]) // capacity)
    for limit in range(half + 1):
        alone = int(number[capacity] - number[capacity - limit])
        large = int(number[capacity - limit] - number[half])
        in_large = int(tokens[capacity - limit] - tokens[half])
        below = int(tokens[limit - 1]) if limit else 0
        rest = int(tokens[half]) - below - (large * capacity - in_large)
        best = max(best, alone + large + max(0, -(-rest // capacity)))
    return best


def _fill(items: Items) -> int:
    return sum(length * n for length, n in items)


def _changed(items: Items, out: tuple[int, ...], into: tuple[int, ...]) -> Items:
    made = Counter(dict(items))
    made.subtract(out)
    made.update(into)
    return tuple(sorted(((length, n) for length, n in made.items() if n), reverse=True))


def exchange(fuller: Items, emptier: Items, room: int) -> tuple[tuple, tuple] | None:
    """Pieces (of the emptier, of the fuller) whose exchange fills most of `room`, if any
    does: a move, one for one, two for one, or one for two."""

    def sums(items: Items) -> tuple[np.ndarray, list[tuple[int, ...]]]:
        ones = [(a,) for a, _ in items]
        twos = [(a, b) for i, (a, n) in enumerate(items)
                for b, _ in (items[i:] if n > 1 else items[i + 1:])]
        return np.array([sum(p) for p in ones + twos]), ones + twos

    giving, given = sums(emptier)
    taking, taken = sums(fuller)
    given_ones, taken_ones = len(emptier), len(fuller)
    best, found = 0, None

    def consider(gains: np.ndarray, givers: list, takers: list) -> None:
        nonlocal best, found
        gains = np.where(gains <= room, gains, 0)
        at = int(gains.argmax())
        if gains.flat[at] > best:
            best = int(gains.flat[at])
            found = givers[at // gains.shape[1]], takers[at % gains.shape[1]]

    consider(giving[:given_ones, None], given, [()])
    for one, more in ((given_ones, taken_ones), (len(given), taken_ones), (given_ones, len(taken))):
        if best == room:
            break
        consider(giving[:one, None] - taking[None, :more], given, taken)
    return found


def local_search(packed: Counter[Items], capacity: int, enough: int,
                 trials: int = TRIALS) -> Counter[Items]:
    """Drain the emptiest sequences into fuller ones until there are `enough` at most.

    An exchange is made in as many pairs of the two classes as there are. A class from
    which nothing can be given is left alone until another class has changed.
    """
    packed = +packed
    total = packed.total()
    open_ = sorted((_fill(i), i) for i in packed if _fill(i) < capacity)
    first = 0  # classes before it have nothing to give
    while total > enough and first < len(open_) and trials > 0:
        emptier = open_[first][1]
        for at in range(len(open_) - 1, first - 1, -1):
            fill, fuller = open_[at]
            if at == first and packed[emptier] < 2:
                continue
            trials -= 1
            swap = exchange(fuller, emptier, capacity - fill)
            if swap or trials <= 0:
                break
        else:
            swap = None
        if not swap:
            first += 1
            continue
        pairs = packed[emptier] // 2 if fuller == emptier else min(packed[fuller], packed[emptier])
        given, taken = swap
        for old, new in ((fuller, _changed(fuller, taken, given)),
                         (emptier, _changed(emptier, given, taken))):
            packed[old] -= pairs
            if new:
                if new not in packed and _fill(new) < capacity:
                    entry = (_fill(new), new)
                    open_.insert(bisect_right(open_, entry), entry)
                packed[new] += pairs
            else:
                total -= pairs
        for gone in {fuller, emptier}:
            if not packed[gone]:
                del packed[gone]
                open_.remove((_fill(gone), gone))
        first = 0
    return packed


@dataclass(frozen=True)
class Plan:
    """Places of all pieces, numbered by length and then by number within the length.

    Run i starts at `starts[i]`: `copies[i]` pieces of a length in each sequence from
    `sequence[i]` on, from `offset[i]` on there.
    """

    first: np.ndarray  # number of the first piece of each length
    starts: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray

    def places(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the nth piece of a length."""
        at = self.first[length] + nth
        run = np.searchsorted(self.starts, at, side="right") - 1
        sequence, turn = np.divmod(at - self.starts[run], self.copies[run])
        return self.sequence[run] + sequence, self.offset[run] + turn * length


def plan(lengths: dict[int, int], capacity: int = CAPACITY, trials: int = TRIALS) -> Plan:
    """As few sequences as best fit and the local search can do with."""
    packed = local_search(best_fit(lengths, capacity), capacity, fewest(lengths, capacity), trials)
    runs: dict[int, list[tuple[int, int, int, int]]] = {length: [] for length in sorted(lengths)}
    sequence = 0
    for items, count in sorted(packed.items(), reverse=True):
        offset = 0
        for length, copies in items:
            runs[length].append((count * copies, sequence, copies, offset))
            offset += length * copies
        sequence += count
    first, starts, rows, at = np.zeros(capacity + 1, np.int64), [], [], 0
    for length, own in runs.items():
        first[length] = at
        for n, *row in own:
            starts.append(at)
            rows.append(row)
            at += n
    columns = np.array(rows, np.int64).reshape(-1, 3).T
    return Plan(first, np.array(starts, np.int64), *columns)


def pack(pieces: DataFrame, capacity: int = CAPACITY, trials: int = TRIALS) -> DataFrame:
    """Add `sequence_id` and `offset` to written pieces, of which `length`, `part` and `nth`
    are read; these last two are dropped. Sequences have no gaps and are numbered from 0."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    lengths = counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    shared = pieces.sparkSession.sparkContext.broadcast(
        plan({r["length"]: r["n"] for r in lengths}, capacity, trials))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(*PRECEDING)
    earlier = counts.select("length", "part", F.coalesce(
        F.sum("_n").over(before), F.lit(0)).alias("_before"))

    def places(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for length, nth in batches:
            sequence, offset = shared.value.places(length.to_numpy(), nth.to_numpy())
            yield pd.DataFrame({"sequence_id": sequence, "offset": offset})

    place = F.pandas_udf(places, "sequence_id long, offset long")
    placed = pieces.join(earlier, ["length", "part"]).withColumn(
        "_at", place("length", F.col("nth") + F.col("_before")))
    return placed.select(*[c for c in pieces.columns if c not in ("part", "nth")], "_at.*")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): the packed ids one after the other, and the
    documents they come from. A sequence is bounded by the capacity."""
    slot = F.struct("offset", "ids", "doc_id")
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(slot)).alias("_slots"))
        .select(
            "sequence_id", "n_tokens",
            F.aggregate("_slots", F.lit(b""), lambda a, s: F.concat(a, s["ids"])).alias("ids"),
            F.transform("_slots", lambda s: s["doc_id"]).alias("doc_ids"),
        )
    )
