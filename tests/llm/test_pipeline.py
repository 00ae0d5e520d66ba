"""Each stage of the corpus pipeline against brute force, on rows with nulls, repeats, odd columns and none at all."""

import random
import re

import pytest

import corpus_pipeline
from simloom.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a b` int, `a.b` int, key string, own int, row_key int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, 1, 2, "k", 3, 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        if k % 4 == 0:
            base = rng.choices(vocabulary, k=rng.randint(3, 50))
        text = list(base)
        if k % 4 and rng.random() < 0.7:
            text[rng.randrange(len(text))] = "changed"
        if k % 5 == 0:
            text += ["awful", "group"]
        rows.append((k, " ".join(text) + ("\ncommon footer\nown %d" % k), rng.choice(["a", "b", None])))
    rows += [rows[7], rows[7], (7, "another text under a used number for once", "a"), (None, "no number here at all", "b"), (None, "no number here at all", "b"), (None, "a different one without number too", None)]
    return [*rows, (500, None, "a"), (501, "", None), (502, " \n", "a"), (503, None, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int("awful" in (t or ""))) for i, t, _ in rows if i is not None and i != 7 and i < 400]
    spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    bench = [(1, " ".join(words(rows[8][1])[:12])), (2, None), (None, "common footer own")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def plain(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def odd_columns(df):
    return {(r["a b"], r["a.b"], r["key"], r["own"], r["row_key"]) for r in df.collect()}


def test_toxicity_stage(spark, rows, sf_dir):
    docs = frame(spark, rows)
    out = corpus_pipeline.toxicity(spark, docs, sf_dir)
    assert out.columns == docs.columns and odd_columns(out) == {(1, 2, "k", 3, 4)}
    assert plain(out) == sorted(((i, t) for i, t, _ in rows if "awful" not in (t or "")), key=repr)


def test_line_dedup_stage(spark, rows, sf_dir):
    out = corpus_pipeline.line_dedup(spark, frame(spark, rows), sf_dir)
    assert odd_columns(out) == {(1, 2, "k", 3, 4)}
    want = []
    for i, t, _ in rows:
        keys = [x.strip().lower() for _, y, _ in rows for x in {z.strip().lower() for z in (y or "").split("\n")}]
        want.append((i, t if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or keys.count(x.strip().lower()) < 10)))
    assert plain(out) == sorted(want, key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_ngram_join_stage(spark, rows, sf_dir):
    out = corpus_pipeline.ngram_join(spark, frame(spark, rows), sf_dir)
    assert out.columns == frame(spark, []).columns and odd_columns(out) == {(1, 2, "k", 3, 4)}
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups, want = {}, []
    for k, (i, t, _) in enumerate(rows):
        if sets[k]:
            groups.setdefault(find(k), []).append((i is None, i or 0, t))
        else:
            want.append((i, t))
    got = plain(out)
    assert len(got) == len(want) + len(groups)
    for own in groups.values():  # of several texts under the smallest number one stays, by its hash
        least = min(own)[:2]
        assert sum((None if x else i, t) in got for x, i, t in set(own)) == 1 and any((None if x else i, t) in got for x, i, t in own if (x, i) == least)
    assert all(x in got for x in want)


def test_decontamination_stage(spark, rows, sf_dir):
    out = corpus_pipeline.decontamination(spark, frame(spark, rows), sf_dir)
    assert odd_columns(out) == {(1, 2, "k", 3, 4)} and out.count() == len(rows)
    passage = words(rows[8][1])[:12]
    for i, t in plain(out):
        low = " ".join(words(t))
        assert "common footer own" not in low and " ".join(passage[:10]) not in low
        assert (t is None) == (i in (500, 503))


def test_mixing_stage_and_empty_tables(spark, rows, sf_dir, tmp_path):
    docs = frame(spark, rows)
    assert sorted(map(tuple, corpus_pipeline.mixing(spark, docs, sf_dir).collect()), key=repr) == sorted(map(tuple, mix_sources(docs).collect()), key=repr)
    none = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).collect() == []


def test_run(spark, rows, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    kept = [r["doc_id"] for r in out.collect()]
    assert set(out.columns) == {"doc_id", "size", "source_size", "target", "taken"}
    assert {500, 501, 502, 503} <= set(kept) and not any(i is not None and i < 120 and i % 5 == 0 for i in kept)
