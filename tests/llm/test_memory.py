"""What a task of the operators holds while it works."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from tests.test_scale_r03 import plan
from titletags.llm import components, line_join, search, simhash, words
from titletags.llm.common import written
from titletags.llm.simhash import drop_near_duplicates, near_duplicates


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 2**20


def test_a_shard_in_the_making_holds_numbers_not_words():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{i}" for i in rng.choice(1000, 200, replace=False))
             for _ in range(2000)]
    queries = pd.DataFrame({"query": [0], "none": [False], "words": [[b"word1", b"word2", b"none"]],
                            "weights": [[1.0, 2.0, 3.0]]})
    block = search._packed(queries, 200.0, 5)
    batch = pd.DataFrame({"_id": range(2000), "none": False, "_text": texts})
    found = []

    def work():
        found.extend(search._searcher(SimpleNamespace(value=block))(iter([batch])))

    assert peak_mb(work) < 10  # 400,000 words as bytes alone are 16 MB
    both = [i for i, t in enumerate(texts) if {"word1", "word2"} <= set(t.split())][:5]
    assert both and list(pd.concat(found)["doc_id"])[:len(both)] == both


def test_frequent_words_are_no_table_of_a_worker():
    """The sets of lines take the frequent words as the arrays that were broadcast."""
    frequent = line_join.frequent_words([f"word{i}".encode() for i in range(1 << 18)])
    lines = pa.array([" word5  WORD3 word5 other\u00a0x", "", " \t", "word3 word3"])
    made = []

    assert peak_mb(lambda: made.append(line_join._Sets(frequent, lines))) < 10
    sets, key = made[0], line_join.FREQUENT + (1 << 18)
    rare = xxhash.xxh64_intdigest("other\u00a0x".encode()) >> 2
    assert sets.n.tolist() == [3, 0, 0, 1]
    assert sets.keys.tolist() == [rare, key - 5, key - 3, key - 3]


def test_words_are_split_as_one_by_one():
    texts = [" A\x0bb\x0c\x1cc ", None, "", "\t\n", "d\u00c9\u00a0e\x85f g\r", "a"]
    found, owner = words.split_words(pa.array(texts))
    want = [(i, w.decode()) for i, t in enumerate(texts) for w in words.words_of(t)]
    assert list(zip(owner.tolist(), found.to_pylist())) == want
    assert list(words.portions(pa.array(["aaaa", "b", None, "cc", "dddddddd"]), 6)) == [
        (0, 1), (1, 4), (4, 5)]


@pytest.mark.parametrize("operator", [near_duplicates, drop_near_duplicates])
def test_what_is_unfolded_from_the_corpus_is_not_broadcast(spark, monkeypatch, operator):
    """However small Spark holds it: keys of fingerprints are sized before they are unfolded."""
    rows = [(i, " ".join(f"w{(i % 40) * 7 + k + (k == i % 3)}" for k in range(60))) for i in range(120)]
    rows.append((119, "another"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = []

    def seen(table):
        plans.append(plan(table))
        return written(table)

    monkeypatch.setattr(simhash, "written", seen)
    monkeypatch.setattr(components, "written", seen)
    operator(docs)
    keyed = [line for p in plans for line in p.splitlines() if "Join" in line and "choice" in line]
    assert len(keyed) >= 3 and all("SortMergeJoin" in line for line in keyed)
