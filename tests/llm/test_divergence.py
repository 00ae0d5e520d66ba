"""Source divergence against brute force on whole numbers; the sketch never gives less than the true count."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simloom.llm import divergence as op
from simloom.llm import terms as counting

#: Extra columns with names that the operator uses inside.
SCHEMA = "doc_id long, text string, lang string, source string, term string, `n` int, h long, bucket string"


def words(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least, top):
    docs, own, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = {(g or "", s or "") for _, g, s in rows}
    for text, lang, source in rows:
        docs[lang or ""].update(set(words(text)))
        own[lang or "", source or ""].update(words(text))
        whole[lang or ""].update(words(text))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        sources = sorted(s for g, s in groups if g == lang)
        p, q = {s: share(own[lang, s]) for s in sources}, share(whole[lang])
        for s in sources:
            parts = {"pair": [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in sources if x != s], "term": [(t, p[s][t] - q[t]) for t in kept if own[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def found(spark, rows, *args, **sizes):
    table = spark.createDataFrame([(k, t, g, s, "x", 1, 2, "b") for k, (t, g, s) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in op.source_divergence(table, *args, **sizes).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("sizes", [{}, {"block": 50, "tile": 3, "bucket": 4}])
def test_brute_force(spark, sizes):
    """Null and empty values, a source without terms, a language of which no term counts, ties, many tiles and buckets."""
    rng = random.Random(7)
    vocabulary = [f"Word{chr(97 + k)}" for k in range(26)] + ["été", "日本", "ß"]
    rows = []
    for k in range(300):
        source = f"s{rng.randint(0, 9)}"
        own = vocabulary[hash(source) % 5 :][:20] if k % 3 else vocabulary
        rows.append((" ".join(rng.choices(own, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), source))
    rows += [(None, "en", "silent"), ("12 34 -", "en", None), ("rare words only", "fr", "a"), ("others", "fr", "b"), ("", "", ""), ("one", "xx", "alone")] + [("worda worda", "en", "copies")] * 5
    assert found(spark, rows, 5, 7, **sizes) == brute(rows, 5, 7)


def test_long_text_in_parts(spark, monkeypatch):
    """A text's terms are counted once for its documents, however many parts it is looked at in."""
    monkeypatch.setattr(counting, "PIECE", 64)
    texts = ["alpha beta " * 50 + "x" * 200, "gamma alpha", None, ""]
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    got = Counter()
    parts = list(counting.counted([batch], op.LETTERS))
    assert len(parts) > 5 and any(p[0] is None for p in parts)
    at = 0
    for rows, text, term, n, (hashes, names) in counting.whole(iter(parts)):
        for t, h, c in zip(text, term, n):
            got[at + int(t), names[int(np.searchsorted(hashes, h))].as_py()] += int(c)
        at += rows.num_rows
    assert at == 4 and got == {(0, "alpha"): 50, (0, "beta"): 50, (0, "x" * 200): 1, (1, "gamma"): 1, (1, "alpha"): 1}


def test_no_rows(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("width,most", [(1 << 20, 400), (1 << 16, 300_000)])
def test_the_sketch_never_underestimates(width, most):
    """Of 300,000 terms in few documents most are dropped, of those in enough none; so in a crowded sketch."""
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 300_000).astype(np.uint64)
    sketch = op.Sketch(width, 30)
    for k in range(30):
        sketch.add(hashes if k < 2 else hashes[::1000])
    left = op.reaches(hashes, np.packbits(sketch.counters >= 30, axis=1))
    assert left[::1000].all() and 300 <= left.sum() <= most and sketch.counters.max() == 30


def test_merged_sketches(spark):
    """Counts that no task has alone are reached together; segments of several tasks are added up."""
    rows = spark.createDataFrame([(f"shared own{k}", "en", "s") for k in range(30)], "text string, lang string, source string").repartition(6)
    texts = rows.select(F.xxhash64("lang").alias("lang_hash"), F.xxhash64("lang", "source").alias("g"), "text")
    assert np.unpackbits(op.possible_terms(texts, 30, 1 << 16)).sum() == 2 * op.DEPTH  # "shared" and "own"
    assert np.unpackbits(op.possible_terms(texts, 31, 1 << 16)).sum() == 0


def test_shares_are_exact_beyond_longs(spark):
    n, whole, terms = 3 * 10**13 + 7, 9 * 10**15 + 1, 10**6 + 3
    row = spark.range(1).select(op._share(F.lit(n), F.lit(whole), F.lit(terms)).alias("x")).first()
    assert row["x"] == 1 + 10**9 * (n + 5) // (whole + 5 * terms)
