"""The filter audit, against every order applied to every document."""

import re
from itertools import permutations

from tests.llm.cases import TEXTS, nothing, table, tricky
from titletags.llm.filter_audit import filter_audit, later_copies
from titletags.llm.queries import QUERIES

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
           "good_lost", "toxic_lost", "shapley")


def failures(doc_id, text, firsts):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and firsts[text] < doc_id,
    }


def brute(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, marked in labels if marked == 1 and i is not None}
    docs = [(i, t or "", p or "") for i, t, p in docs]
    firsts = {}
    for i, t, _ in docs:
        firsts[t] = min(firsts.get(t, float("inf")), float("inf") if i is None else i)
    out = []
    for part in {p for *_, p in docs}:
        rows = [(i, failures(i, t, firsts)) for i, t, p in docs if p == part]
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if r[1][letter]]
                failing = sum(f[letter] for _, f in rows)
                left = [r for r in left if not r[1][letter]]
                alone = sum(f[letter] and sum(f.values()) == 1 for _, f in rows)
                out.append([part, "".join(order), step, len(left), len(gone),
                            failing - len(gone), alone, sum(i in good for i, _ in gone),
                            sum(i in toxic for i, _ in gone)])
    for row in out:
        letter = row[1][row[2] - 1]
        row.append(sum(r[4] for r in out if r[0] == row[0] and r[1][r[2] - 1] == letter))
    return sorted(map(tuple, out))


def rows_of(found):
    return sorted(tuple(r[c] for c in COLUMNS) for r in found.collect())


def test_audit_of_the_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, sf_dir).collect()]
    marks = [tuple(r) for r in table(spark, sf_dir, "labels")
             .select("doc_id", "quality", "toxic").collect()]
    got = QUERIES["op13_filter_audit"](spark, sf_dir)
    assert set(got.columns) == set(COLUMNS)
    kinds = dict(got.dtypes)
    assert kinds.pop("step") == "int" and kinds.pop("part") == kinds.pop("filter_order") == "string"
    assert set(kinds.values()) == {"bigint"}
    assert rows_of(got) == brute(docs, marks)


def test_audit_of_tricky_documents(spark):
    marks = [(1, 1, 0), (1, 0, 1), (9, 1, 1), (None, 1, 1), (7, None, None), (5, 1, None)]
    labels = spark.createDataFrame([(*m, "clash") for m in marks],
                                   "doc_id long, quality int, toxic int, text string")
    docs = tricky(spark).withColumnRenamed("bits", "part").withColumnRenamed("kept", "n")
    want = brute([(i, t, lang) for i, t, lang, _ in TEXTS], marks)
    assert rows_of(filter_audit(docs, labels)) == want
    unlabelled = filter_audit(docs, labels.filter("false"))
    assert {r["good_lost"] + r["toxic_lost"] for r in unlabelled.collect()} == {0}
    assert filter_audit(nothing(spark), labels).count() == 0


def test_copies_of_smaller_ids(spark):
    texts = [(5, "same"), (3, "same"), (3, "same"), (9, "same"), (None, "same"), (1, "other"),
             (2, None), (4, None), (6, ""), (7, "")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in later_copies(rows).collect()) == [5, 7, 9]
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', string(id)) as text")
    assert later_copies(many).count() == 999
