"""Lexical search: sums and best ones of bitmaps against plain numbers, search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from simloom.llm import lexical as op

#: Extra columns with names that the operator uses inside.
DOCS = "doc_id long, text string, block long, term string, `places` string"
ITEMS = "item_id string, text string, rank int, score long"


def sliced(values, words):
    values = np.asarray(values)
    bits = np.zeros((op.SLICES, 64 * words), np.uint8)
    bits[:, : len(values)] = values >> np.arange(op.SLICES)[:, None] & 1
    return np.packbits(bits, axis=1).view(np.uint64)


def plain(bits, n):
    return op._values(bits, np.arange(n)).tolist()


def test_products_and_sums_by_carry():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 10**6, (7, 100))
    by = [1, 3, 1000, 16383, 12345, 2, 7]
    grown = op._times(np.concatenate([sliced(v, 2) for v in values], axis=1), np.repeat(np.array(by), 2))
    spread = grown.reshape(len(grown), 7, 2).transpose(1, 0, 2)
    assert [plain(x, 100) for x in spread] == [(v * b).tolist() for v, b in zip(values, by)]
    lists = [np.array([0, 1, 2, 3, 4, 5, 6, 3]), np.array([2, 2, 2]), np.array([6])]
    sums = op._summed(spread, lists)
    for k, own in enumerate(lists):
        assert plain(sums[:, k], 100) == sum(values[x] * by[x] for x in own).tolist()


@pytest.mark.parametrize("n,top", [(5, 3), (100, 3), (100, 10**6), (128, 1)])
def test_best_of_slices(n, top):
    values = np.random.default_rng(n).integers(0, top, n)
    best = op._best(sliced(values, -(-n // 64)), n, 10)
    assert sorted(best.tolist()) == sorted(sorted(range(n), key=lambda x: (-values[x], x))[:10])


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    lists = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in lists]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc_id, own), size in zip(lists, sizes):
            m = 25 + (75 * size * n) // max(1, total)
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t, r in Counter(terms(text)).items() if own[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, nth, None if none else i, -s) for nth, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **sizes):
    tables = [spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS), spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)]
    return sorted((tuple(r) for r in op.lexical_search(*tables, **sizes).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_docs": 7, "block_postings": 100, "query_terms": 20}])
def test_search(spark, sizes):
    """Ties, repeated and null ids, texts without terms, a word that all documents have, a very long text."""
    rng = random.Random(4)
    words = [f"W{k}" for k in range(60)] + ["été", "日本", "x_y", "42"]
    docs = [(k * 7 % 301, "common " + " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(300)]
    docs += [(None, "common w1 w2 w3"), (None, None), (5, ""), (5, "common w1 w2 w3"), (5, "common w1 w2 w3"), (400, "common " + " ".join(rng.choices(words, k=300_000)))]
    items = [("a", "w1 W1 w2 nothing"), ("b", None), ("c", ""), ("d", "unknown"), ("e", "common"), (None, "été 日本"), ("a", "w3"), ("g", " ".join(rng.choices(words, k=80)))]
    assert found(spark, docs, items, **sizes) == brute(docs, items, 10)


def test_few_or_no_rows(spark):
    assert found(spark, [], [("a", "x")]) == [] == found(spark, [(1, "x")], [])
    assert found(spark, [(1, None), (2, "")], [("a", "x")]) == []
    docs = [(1, "x y"), (2, "x"), (3, "z")]
    assert found(spark, docs, [("a", "y")]) == brute(docs, [("a", "y")], 10)
    assert found(spark, [(k, "q w") for k in range(40)] + [(99, "r")], [("a", "w")], k=3) == brute([(k, "q w") for k in range(40)] + [(99, "r")], [("a", "w")], 3)


def test_the_index_holds_all_terms(spark):
    docs = [(k, f"term{k} shared") for k in range(50)]
    index = op.build_index(spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS), block_docs=20)
    counts = {r["term"]: r["n"] for r in index.where("term IS NOT NULL").groupBy("term").agg({"df": "sum"}).toDF("term", "n").collect()}
    assert counts == {"shared": 50} | {f"term{k}": 1 for k in range(50)}
    assert "In(term, [term3,term4])" in index.where("term IN ('term3', 'term4')")._jdf.queryExecution().toString()
