"""Packing into sequences, against the tokenizer and a plain best fit."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import LONG, TEXTS, nothing, table, tricky
from titletags.llm import packing
from titletags.llm.common import written
from titletags.llm.queries import QUERIES
from titletags.llm.settings import END_ID, WORD_PIECES
from titletags.llm.word_pieces import WordEncoder


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(WORD_PIECES)
    found.encode_special_tokens = True
    return found


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    """Longest first, each where least room is left; one piece at a time."""
    room = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in room if r >= length]
        if fitting:
            least = min(fitting)
            room[room.index(least)] = least - length
        else:
            room.append(capacity - length)
    return len(room)


def cut(texts, tokenizer, capacity):
    out = []
    for doc_id, text in texts:
        ids = [*ids_of(tokenizer, text), END_ID]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start:start + capacity], "<u4")
            out.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    return out


def holds(rows, capacity):
    """Pieces lie in their sequence without gap or overlap; returns the sequences used."""
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in placed.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def sort_key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def test_documents_are_packed(spark, sf_dir, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir).collect()]
    want = cut(texts, tokenizer, packing.CAPACITY)
    got = QUERIES["op11_best_fit_packing"](spark, sf_dir)
    assert dict(got.dtypes) == {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
        "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = got.collect()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted((tuple(r[c] for c in names) for r in rows), key=sort_key) == sorted(want, key=sort_key)
    lengths = [w[3] for w in want]
    used = holds(rows, packing.CAPACITY)
    assert -(-sum(lengths) // packing.CAPACITY) <= used <= plain_best_fit(lengths, packing.CAPACITY)


@pytest.mark.parametrize("capacity", [1, 3, 64])
def test_tricky_documents_are_packed(spark, tokenizer, capacity):
    texts = [(i, t) if t is None or len(t) < 1000 else (i, t[:300]) for i, t, *_ in TEXTS]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in texts],
                                 "doc_id long, text string, ids string, part long")
    pieces = written(packing.token_pieces(docs, WORD_PIECES, END_ID, capacity))
    packed = packing.pack(pieces, capacity)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = packed.collect()
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows]
    want = cut(texts, tokenizer, capacity)
    assert sorted(got, key=sort_key) == sorted(want, key=sort_key)
    lengths = [w[3] for w in want]
    used = holds(rows, capacity)
    assert used <= plain_best_fit(lengths, capacity)
    whole = packing.sequences(packed).collect()
    assert len(whole) == used and sum(r["n_tokens"] for r in whole) == sum(lengths)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * capacity for r in whole)
    assert Counter(i for r in whole for i in r["doc_ids"]) == Counter(w[0] for w in want)


def test_nothing_and_long_documents(spark, tokenizer):
    none = written(packing.token_pieces(nothing(spark), WORD_PIECES, END_ID))
    assert packing.pack(none).count() == 0
    assert packing.sequences(packing.pack(none)).count() == 0
    pieces = written(packing.token_pieces(tricky(spark).filter("doc_id = 7"), WORD_PIECES, END_ID))
    ids = b"".join(bytes(r["ids"]) for r in pieces.orderBy("piece").collect())
    assert np.frombuffer(ids, "<u4").tolist() == [*ids_of(tokenizer, LONG), END_ID]


def test_ids_are_those_of_the_tokenizer(tokenizer):
    draw = random.Random(1)
    signs = ("abcXYZ'stmlld0159_ \t\n\r\x0b\x0c\x1c\x1f\x00\x7f\x85\xa0ÉéÀ²¼ªºß·œ̱̈İΣσς"
             "ǅ漢字🙂​­﻿ͅ.,!<|>")
    encoder = WordEncoder(WORD_PIECES, remembered=50)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(25))) for _ in range(3000)]
    for text in [*texts, None, "", " \t", "It's we'll THEY'RE <|endoftext|> 'sword"]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids_of(tokenizer, text)


def expanded(packed):
    return sorted((items for items, n in packed.items() for _ in range(n)), reverse=True)


@pytest.mark.parametrize("seed", range(30))
def test_plan_against_plain_best_fit(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 20, 100])
    lengths = Counter(draw.randint(1, capacity) for _ in range(draw.choice([1, 10, 300])))
    packed = packing.best_fit(lengths, capacity)
    assert all(packing._fill(items) <= capacity for items in packed)
    held = Counter()
    for items, n in packed.items():
        for length, copies in items:
            held[length] += n * copies
    assert held == lengths
    plain = plain_best_fit(lengths.elements(), capacity)
    assert packed.total() == plain >= packing.fewest(lengths, capacity)
    better = packing.local_search(packed, capacity, packing.fewest(lengths, capacity))
    assert packing.fewest(lengths, capacity) <= better.total() <= plain
    held = Counter()
    for items, n in better.items():
        assert packing._fill(items) <= capacity and n > 0
        for length, copies in items:
            held[length] += n * copies
    assert held == lengths


def fewest_by_trying(lengths, capacity):
    """The true minimum, by trying all ways."""
    best = [len(lengths)]
    lengths = sorted(lengths, reverse=True)

    def place(at, room):
        if len(room) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(room)
            return
        for r in set(room):
            if r >= lengths[at]:
                i = room.index(r)
                place(at + 1, [*room[:i], r - lengths[at], *room[i + 1:]])
        place(at + 1, [*room, capacity - lengths[at]])

    place(0, [])
    return best[0]


def test_local_search_finds_what_best_fit_misses():
    """Cases in which best fit is not the best: the search closes some of the gaps and is
    never worse; no bound is above the true minimum."""
    missed = found = 0
    for seed in range(250):
        draw = random.Random(seed)
        capacity = 24
        lengths = Counter(draw.randint(3, 13) for _ in range(10))
        first = packing.best_fit(lengths, capacity)
        true = fewest_by_trying(list(lengths.elements()), capacity)
        low = packing.fewest(lengths, capacity)
        after = packing.local_search(first, capacity, low)
        assert low <= true <= after.total() <= first.total()
        missed += first.total() > true
        found += after.total() < first.total()
    assert missed and found >= missed / 2


def test_exchanges_raise_the_squared_fill_in_all_copies():
    """Two classes with many copies: 9+5 of 20 and 10+6 become 10+9 (and 6+5) all at once."""
    packed = Counter({((9, 1), (5, 1)): 1000, ((10, 1), (6, 1)): 1000})
    after = packing.local_search(packed, 20, 0)
    assert sum(n * packing._fill(i) for i, n in after.items()) == 30_000
    assert sum(n * packing._fill(i) ** 2 for i, n in after.items()) > 1000 * (14**2 + 16**2)
    move = packing.exchange(((10, 1),), ((7, 1), (3, 1)), 8)
    assert move == ((7,), ())
    swap = packing.exchange(((10, 1), (6, 1)), ((8, 1),), 4)
    assert swap == ((8,), (6,))
    two = packing.exchange(((10, 1), (6, 1)), ((5, 2),), 4)
    assert two == ((5, 5), (6,))
    assert packing.exchange(((20, 1),), ((20, 1),), 0) is None


def test_places_cover_every_sequence():
    lengths = Counter({4: 7, 3: 5, 1: 30, 9: 2})
    plan = packing.plan(lengths, 10)
    taken = Counter()
    for length, n in lengths.items():
        sequence, offset = plan.places(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            taken.update((s, o + i) for i in range(length))
    assert set(taken.values()) == {1} and len(taken) == sum(k * n for k, n in lengths.items())
