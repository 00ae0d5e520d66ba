"""Edge cases and brute-force comparisons of the training-data operators."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.llm import exact_dedup as golomb
from simloom.llm import ngram_join, warc
from simloom.llm.components import components
from simloom.llm.decontaminate import contamination, remove_contamination
from simloom.llm.exact_dedup import exact_dedup
from simloom.llm.line_dedup import drop_common_lines, line_report
from simloom.llm.lm_score import lm_scores
from simloom.llm.mixing import mix_sources
from simloom.llm.ngram_join import ngram_jaccard_join
from simloom.llm.toxicity import drop_toxic, toxicity_scores
from simloom.llm.trie import linked
from simloom.llm.words import SPACED, hashed, spans

WORDS = [f"w{k}" for k in range(40)]
#: Extra columns with names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, row string, `hits` string, size long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "r", "h", 9) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    long = " ".join(rng.choices([f"v{k}" for k in range(9999)], k=60_000))
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "Same text here", "b"), (5, "same  text here", "b"), (5, "same  text here", "b"), (None, "Same text here", None), (7, long, "c"), (8, long + " x", "c"), (9, "\u00c9t\u00e9 \u65e5\u672c \x00 z", "c")]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, ids = [shingles(t) for _, t in rows], [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        own = [ids[m] for m in range(len(rows)) if find(m) == find(k) and ids[m] is not None]
        out.append((i, len(sets[k]), min(own) if own else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_ngram_join(spark, most):
    rng, rows = random.Random(5), []
    for k in range(60):
        if k % 3 == 0:
            base = rng.choices(WORDS, k=rng.randint(1, 60))
        text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice(WORDS)
        rows.append((k, " ".join(text)))
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    assert sorted((tuple(r) for r in ngram_jaccard_join(docs, most).drop("root").collect()), key=repr) == brute_components(rows)


@pytest.mark.parametrize("most", [250, 120])
def test_ngram_join_of_large_components(spark, monkeypatch, most):
    """Chains of near copies, and texts half of one chain and half of the next: candidates that are no links."""
    rng, rows, rounds = random.Random(9), [], []
    starts = [[f"f{f}w{k}" for k in range(60)] for f in range(4)]
    for f, start in enumerate(starts):
        text = list(start)
        for k in range(14):
            rows.append((len(rows), " ".join(text)))
            text[(k * 4) % 60] = f"m{f}x{k}"
        for _ in range(3):
            rows.append((len(rows), " ".join(start[:30] + starts[(f + 1) % 4][30:])))
    rng.shuffle(rows)
    exactly = ngram_join._exactly
    monkeypatch.setattr(ngram_join, "_exactly", lambda *a: rounds.append(1) or exactly(*a))
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    assert sorted((tuple(r) for r in ngram_jaccard_join(docs, most).drop("root").collect()), key=repr) == brute_components(rows)
    assert len(rounds) == 2


def test_ngram_join_odd(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in ngram_jaccard_join(odd).drop("root").collect()), key=repr) == brute_components(rows)
    assert ngram_jaccard_join(none).collect() == []


def test_hashes_do_not_depend_on_pieces():
    text = (" ".join(f"Word{k % 97}" for k in range(500)) + " " + "x" * 3000 + " tail").encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), SPACED)
    whole = hashed(data, starts, ends)
    for piece in (1, 50, 1000):
        assert np.array_equal(hashed(data, starts, ends, piece), whole)
    assert len(set(whole.tolist())) == 99 and whole[0] == whole[97]


def test_trie_against_all_pairs():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 500, 60).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.where(rng.random(len(x)) < 0.08, rng.integers(0, 500, len(x)), x.astype(int)).astype(np.uint64)) for x in base for _ in range(8)]
    roots = linked(sets)
    link = [[len(np.intersect1d(a, b)) * 100 >= 75 * len(np.union1d(a, b)) for b in sets] for a in sets]
    reach = np.linalg.matrix_power(np.array(link, float), 48) > 0
    assert all((roots[i] == roots[j]) == reach[i, j] for i in range(len(sets)) for j in range(len(sets)))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (90, 80)], "src long, dst long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {k: 0 for k in range(41)} | {90: 80, 80: 80}


def test_golomb_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        assert np.array_equal(golomb.golomb_decode(golomb.golomb_encode(x)), x)
    ends = np.array([0, 1, 2**64 - 1], np.uint64)
    assert np.array_equal(golomb.golomb_decode(golomb.golomb_encode(ends)), ends)


def test_exact_dedup_odd(odd, none):
    rows = exact_dedup(odd.repartition(3)).collect()
    groups = {}
    for r in odd.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), []).append(r["doc_id"])
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in rows if r["text_sha256"] == sha]
        known = [i for i in ids if i is not None]
        assert len(own) == len(ids) and {r["group_size"] for r in own} == {len(ids)} and {r["keep_id"] for r in own} == {min(known) if known else None}
        assert sum(r["kept"] for r in own) == 1
    assert exact_dedup(none).collect() == []


def test_contamination_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "same TEXT here"), (2, "same text here"), (None, "\u00e9t\u00e9 \u65e5\u672c"), (3, None), (4, ""), (5, "v1 v2")], "item_id long, text string")
    rows = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in contamination(odd, bench).collect()}
    assert {(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 3, 3, 2), (5, 3, 3, 2), (None, 3, 3, 2)} <= rows
    assert contamination(none, bench).collect() == [] and not any(r["contaminated"] for r in contamination(odd, bench.limit(0)).collect())
    cut = remove_contamination(documents(spark, [(1, "Alpha, same text here! omega", "a"), (2, None, "a")]), bench)
    assert [(r["doc_id"], r["text"], r["hits"]) for r in cut.orderBy("doc_id").collect()] == [(1, "Alpha, ! omega", "h"), (2, None, "h")]


def test_contamination_in_blocks(spark, odd):
    rng = random.Random(11)
    items = [" ".join(rng.choices(WORDS, k=rng.randint(3, 25))) for _ in range(12)]
    bench = spark.createDataFrame([*enumerate(items), (20, None), (21, "w1 w2"), (22, "w2 w3")], "item_id long, text string")
    rows = [(k, ", ".join([*rng.choices(WORDS, k=9), *items[k % 12].split()[: rng.randint(1, 25)], "End", *rng.choices(WORDS, k=9), "w1 w2 w3"]), "a") for k in range(40)]
    docs = documents(spark, [*rows, (90, None, "a"), (91, "", "a"), (92, "nothing of it", "a")]).withColumn("State_bits", F.lit(7))
    want = {}
    for i, text in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        own, hit, found = re.findall(r"[a-z0-9]+", (text or "").lower()), set(), set()
        for number, item in [*enumerate(items), (21, "w1 w2"), (22, "w2 w3")]:
            w = item.split()
            width = min(10, len(w))
            windows = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
            for at in range(len(own) - width + 1):
                if tuple(own[at : at + width]) in windows:
                    hit |= set(range(at, at + width))
                    found.add(str(number))
        want[i] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for most in (2_000_000, 30):
        assert {r["doc_id"]: tuple(r)[1:] for r in contamination(docs, bench, most).collect()} == want
    whole = sorted(map(tuple, remove_contamination(docs, bench).select("doc_id", "text", "State_bits").fillna("-").collect()))
    assert whole == sorted(map(tuple, remove_contamination(docs, bench, most_words=30).select("doc_id", "text", "State_bits").fillna("-").collect()))
    assert len(whole) == 43 and all("w1 w2 w3" not in text for _, text, _ in whole)
    for most in (2_000_000, 30):
        assert {r["doc_id"] for r in remove_contamination(docs, bench, True, most).collect()} == {i for i, x in want.items() if not x[4]}


def test_line_dedup(spark, odd, none):
    docs = documents(spark, [(k, f"own {k}\n  COMMON line\t\n\nlast", "a") for k in range(12)] + [(20, None, "a"), (21, "x", "a")])
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_report(docs).collect()}
    assert got[3] == (4, 2, hashlib.sha256(b"own 3\n").hexdigest()) and got[20] == (1, 0, hashlib.sha256(b"").hexdigest())
    kept = {r["doc_id"]: (r["text"], r["row"]) for r in drop_common_lines(docs).collect()}
    assert kept[3] == ("own 3\n", "r") and kept[20] == (None, "r") and kept[21] == ("x", "r")
    assert line_report(none).collect() == [] and line_report(odd).count() == odd.count()


def test_toxicity(spark, odd, none):
    rng, rows, labels = random.Random(6), [], []
    for k in range(300):
        text = rng.choices(WORDS, k=20)
        if k % 4 == 0:
            text[7] = "badword"
        rows.append((k, " ".join(text), "a"))
        labels.append((k, int(k % 4 == 0)))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, rows)
    got = toxicity_scores(docs, marks).collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    assert drop_toxic(docs, marks).columns == docs.columns and drop_toxic(docs, marks).count() == sum(1 - r["predicted"] for r in got)
    assert toxicity_scores(odd, marks.limit(0)).count() == odd.count() and toxicity_scores(none, marks).collect() == []


def test_toxicity_of_pairs_alone(spark):
    """Toxic where both or none of two words stand, so that neither tells alone."""
    rng, rows, labels = random.Random(8), [], []
    for k in range(3000):
        text, a, b = rng.choices(WORDS, k=20), k % 2, k // 2 % 2
        text[3], text[9] = "alpha" if a else text[3], "beta" if b else text[9]
        rows.append((k, " ".join(text), "a"))
        labels.append((k, int(a == b)))
    got = toxicity_scores(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.95


def test_mixing(spark, odd, none):
    rows = [(k, " ".join(["w"] * (k % 30)), f"s{k % 5}" if k % 7 else None) for k in range(400)] + [(999, "one", "tiny")]
    got = mix_sources(documents(spark, rows)).collect()
    again = mix_sources(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    source = {i: s for i, _, s in rows}
    targets = {source[r["doc_id"]]: r["target"] for r in got}
    for name, target in targets.items():
        assert abs(sum(r["taken"] for r in got if source[r["doc_id"]] == name) - target) <= 24
    assert abs(sum(targets.values()) - sum(r["size"] for r in got)) < 1e-6
    assert mix_sources(none).collect() == [] and mix_sources(odd).count() == odd.count()


@pytest.mark.parametrize("order,least,passes", [(3, 2, 4), (1, 2, 1), (2, 1, 3), (4, 3, 2)])
def test_lm_scores(spark, order, least, passes):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(WORDS[:8], k=rng.randint(0, 12)))) for k in range(50)]
    rows += [(60, None), (61, " \n"), (62, rows[3][1]), (62, rows[3][1]), (None, "w1 w2 W3")]
    counts, total = Counter(), 0
    for _, t in rows:
        w = words(t)
        total += len(w)
        counts.update(tuple(w[k : k + n]) for n in range(1, order + 1) for k in range(len(w) - n + 1))

    def score(gram):
        if len(gram) == 1:
            return counts[gram] / total
        return counts[gram] / counts[gram[:-1]] if counts[gram] >= least else 0.4 * score(gram[1:])

    want = []
    for i, t in rows:
        w = words(t)
        v = sum(np.log(score(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        want.append((i, len(w), round(v, 4), round(v / len(w), 4) if w else None))
    docs = documents(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    got = [(r[0], r[1], round(r[2], 4), r[3] if r[3] is None else round(r[3], 4)) for r in lm_scores(docs, order, least=least, block_words=60, passes=passes).collect()]
    near = lambda x: (str(x[0]), x[1])
    for x, y in zip(sorted(got, key=lambda x: (near(x), x[2])), sorted(want, key=lambda x: (near(x), x[2]))):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=2e-4) and (x[3] is y[3] is None or x[3] == pytest.approx(y[3], abs=2e-4))
    assert len(got) == len(want)


def test_lm_scores_odd(odd, none):
    assert lm_scores(odd).count() == odd.count() and lm_scores(none).collect() == []


def pages(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, digest long")


def test_warc(spark):
    rows = [(k, f"http://Site{k % 3}.example.org/a/{k}?x={k}", f"<p>{k % 10}\u00e9</p>") for k in range(40)] + [(50, None, None), (51, "no scheme", ""), (None, "http://b.org", "<p>0\u00e9</p>")]
    archive = warc.write_archive(pages(spark, rows), file_bytes=600, block_lines=7)
    got = {r["page_id"]: r for r in archive.read(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == raw and i is not None]
        r = got[page_id]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page_id == max(same) else ("revisit", max(same)))
    for page_id, url, html in rows[30:40]:
        found = archive.lookup(url)
        assert [int(x["x-page-id"]) for x in found] == [page_id] and found[0]["payload"].decode() == html
    assert archive.lookup("http://nowhere.test/") == []
    assert warc.write_archive(pages(spark, [])).read(pages(spark, rows)).collect() == [] and archive.read(pages(spark, [])).collect() == []
    some = pages(spark, [rows[4], rows[31], rows[31], (1, "http://nowhere.test/", None)])
    assert sorted(r["page_id"] for r in archive.read(some).collect()) == [4, 31]


def test_warc_of_one_url_in_many_blocks(spark):
    """Captures of one key run over blocks and files; a long payload; the largest page_id repeated."""
    rows = [(k, "http://a.org/x", f"p{k}") for k in range(40)] + [(99, "http://b.org/", "same" * 300_000), (99, "http://b.org/", "same" * 300_000), (7, "http://c.org/", "same" * 300_000)]
    archive = warc.write_archive(pages(spark, rows).repartition(5), block_lines=3)
    assert sorted(int(x["x-page-id"]) for x in archive.lookup("http://A.org/x")) == list(range(40))
    got = archive.read(pages(spark, rows)).collect()
    assert len(got) == 43 and sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] > 9) == [(7, "revisit", 99), (99, "response", None), (99, "response", None)]
    index = warc.Index(archive.blocks, archive.known())
    assert len(list(index.captures("org,b)/"))) == 2 and index.reads <= 2 * len(archive.known())
