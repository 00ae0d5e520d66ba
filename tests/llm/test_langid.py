"""Language identification: best paths against all paths, letters, spans of mixed text, held-out accuracy, the sample."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.llm import langid
from simloom.llm.langid import LanguageModel, language_id, learn

PARTS = {"en": ["th", "er", "on", "an", "ing"], "de": ["sch", "ung", "ich", "ein"], "fr": ["que", "eau", "oui", "ai"], "ru": ["ста", "ово", "ени"], "el": ["τον", "και", "ους"]}


def text(rng, lang, n=30):
    return " ".join("".join(rng.choices(PARTS[lang], k=3)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(k, text(rng, list(PARTS)[k % 5]), list(PARTS)[k % 5]) for k in range(400)]
    rows += [(900, None, "en"), (901, "12 34 !", "de"), (None, "thering onan", None), (902, "", None), (903, "thering " * 20_000, None), (904, rows[3][1], "ru"), (904, rows[3][1], "ru")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit(1)).withColumn("score", F.lit("x"))


@pytest.fixture(scope="module")
def model(docs):
    return learn(docs)


@pytest.mark.parametrize("segment", [2, 512])
@pytest.mark.parametrize("most_cut", [0, 12])
def test_best_path_is_the_best_of_all(monkeypatch, segment, most_cut):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    monkeypatch.setattr(langid, "MOST_CUT", most_cut)
    rng = np.random.default_rng(5)
    model = LanguageModel(["a", "b", "c"], None, None)
    lengths = [0, 1, 7, 3, 0, 6, 2, 5]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score = np.round(-rng.random((first[-1], 3)) * 4, 2).astype(np.float32)
    got = model.paths(score, first, penalty=1.5)
    for a, b in zip(first[:-1], first[1:]):
        worth = lambda path: sum(float(score[a + k, x]) for k, x in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
        best = max(map(worth, itertools.product(range(3), repeat=b - a))) if b > a else 0
        assert worth(got[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def test_letters_by_category(model):
    for word in ("\U0001f600\U0001f680", "，。", "！？", "١٢٣", "×÷", "٣", "12.5", "́̂", "①", "€ §"):
        assert model.predict(*langid._lower(langid.pa.array([word])))[0] == ["und"], word
    for word in ("ⵣⴰⵎ", "ªº", "µ", "日本", "मानक", "a", "\U00010400"):
        assert model.predict(*langid._lower(langid.pa.array([word])))[0][0] in PARTS, word


def test_scripts_narrow_languages(model):
    assert model.predict(*langid._lower(langid.pa.array(["жжж"])))[0] == ["ru"]
    assert model.predict(*langid._lower(langid.pa.array(["ΨΨΨ"])))[0] == ["el"]


def test_spans_of_mixed_text(model):
    rng = random.Random(9)
    parts = [("en", 12), ("ru", 8), ("de", 15), ("fr", 10)]
    mixed = " -- ".join(text(rng, lang, n) for lang, n in parts)
    assert [(b - a, lang) for a, b, lang in model.spans(mixed)] == [(n, lang) for lang, n in parts]
    assert model.spans("") == [] == model.spans("1 2")


def test_held_out_accuracy_and_odd_rows(spark, docs):
    got = language_id(docs).collect()
    assert len(got) == docs.count()
    by_id = {r["doc_id"]: r for r in got}
    known = {r["doc_id"]: r["lang"] for r in docs.where("doc_id < 400").collect()}
    held = [by_id[i]["lang_pred"] == lang for i, lang in known.items() if by_id[i]["held_out"]]
    assert len(held) > 60 and np.mean(held) > 0.97
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by_id[None]["lang_pred"] == "en" == by_id[903]["lang_pred"]
    assert all(0 <= r["score"] <= 1 for r in got) and by_id[900]["score"] == 0
    assert language_id(docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_lang_source_and_id_are_no_inputs(docs):
    changed = docs.withColumn("lang", F.when(langid.held_out(), "en").otherwise(F.col("lang")))
    assert sorted(map(repr, map(tuple, language_id(changed).collect()))) == sorted(map(repr, map(tuple, language_id(docs).collect())))


def test_sample_is_bounded(spark):
    rng = random.Random(1)
    rows = [(k, text(rng, "en", 5), "en") for k in range(3000)] + [(5000 + k, text(rng, "de", 5), "de") for k in range(40)]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    take = langid.written
    langid.written, kept = (lambda df, name: seen.extend(df.collect()) or take(df, name)), take
    try:
        assert learn(few, 50).languages == ["de", "en"]
    finally:
        langid.written = kept
    chosen = [r["lang"] for r in seen if "doc_id" in r]
    assert chosen.count("en") == 50 and 0 < chosen.count("de") <= 40
