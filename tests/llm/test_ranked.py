"""Ranked search against a plain scorer: ties, repeats, nulls, small blocks and bundles."""

import math
import random
import re

import pytest

from gleanframe.llm.ranked import top_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    lists = [(i, words(t)) for i, t in docs]
    lists = [(i, w) for i, w in lists if w]
    n_docs, n_words = len(lists), sum(len(w) for _, w in lists)
    df = {}
    for _, w in lists:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, w in lists:
            m = 10 + 90 * len(w) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m))
                    for t in terms if t in w)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def fixture():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "x9"]
    docs = [(i, " ".join(draw.choice(vocabulary[: draw.choice([5, 20, 62])]) for _ in range(draw.choice([1, 5, 60])))) for i in range(150)]
    docs += [(200 + i, "w1 w2 copied text W3") for i in range(30)] + [(3, docs[3][1]), (None, "w1 w2"), (900, None), (901, ""), (902, "!?")]
    docs.append((950, "w7 " * 30_000 + "w8"))
    items = [(1, "w1, W2 w3"), (2, "w40 w41 w42 w1 w1"), (3, None), (4, "nowhere"), (None, "Éa x9"), (1, "w50"), (5, "w7 w8"),
             (6, " ".join(vocabulary))]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"block_docs": 7, "bundle_items": 2, "owners": 3}, {"owners": 1}])
def test_matches_plain_scores(spark, how):
    docs, items = fixture()
    left = spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, rank int, block string").repartition(3)
    right = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in top_documents(left, right, **how).collect()), key=repr)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert top_documents(docs.limit(0), items).count() == 0
    assert top_documents(docs, items.limit(0)).count() == 0
    assert top_documents(docs.limit(0), items).columns == ["item_id", "rank", "doc_id", "score"]


def test_copies_of_one_text_fill_no_result_twice(spark):
    docs = [(i, "alpha beta") for i in range(400)] + [(1000 + i, f"gamma{i} beta") for i in range(100)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = top_documents(table, spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), block_docs=64)
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(10))
