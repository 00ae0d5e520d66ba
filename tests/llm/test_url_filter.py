"""URL filters against brute force: hosts and paths, explicit rules, mined rules."""

import itertools
import random
import re
from collections import Counter

import pytest

from simloom.llm.url_filter import RULES, judge_urls, mine_rules

SCHEMA = "page_id long, url string, html string, `key` int, `rule` int, tokens int, `a.b` int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "", 1, 2, 3, 4) for r in rows], SCHEMA)


def low(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def host_path(url):
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return low(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def explicit(host, path, rules):
    fit = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def tokens(url):
    if url is None:
        return frozenset()
    host, path = host_path(url)
    labels = host.split(".")
    out = {f"tld={labels[-1]}", f"site={'.'.join(labels[-2:])}", f"host={host}", *(f"label={x}" for x in labels[:-2])}
    out |= {f"path{k}={x}" for k, x in enumerate(x for x in re.sub("[0-9]+", "#", path).split("/") if x)}
    if m := re.search(r"\.([A-Za-z0-9]+)$", path):
        out.add(f"suffix={m[1].lower()}")
    if m := re.match(r"(?s)[^?#]*\?([^#]*)", url):
        out |= {f"query={x.split('=')[0]}" for x in m[1].split("&") if x}
    return frozenset(out)


def brute_rules(labelled, support, confidence):
    rows = [(tokens(u), v) for u, v in labelled if v is not None and tokens(u)]
    sets, hits = Counter(), Counter()
    for own, verdict in rows:
        for k in range(1, len(own) + 1):
            for x in itertools.combinations(sorted(own), k):
                sets[x] += 1
                hits[x, verdict] += 1
    least = max(1, -(-len(rows) * support // 1))
    found = {(x, v): (n / sets[x], n / len(rows)) for (x, v), n in hits.items() if n >= least and n / sets[x] >= confidence}
    return {(x, v): y for (x, v), y in found.items() if not any((tuple(t for t in x if t != gone), v) in found and found[tuple(t for t in x if t != gone), v][0] >= y[0] for gone in x)}


@pytest.fixture(scope="module")
def urls():
    rng = random.Random(2)
    out = []
    for k in range(150):
        host = rng.choice(["win.example.net", "www.win.example.net", "shop.test", "Blog.Site.NET", "example.org", "a.example.org", "notexample.org", "x.com"])
        out.append(f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['de', 'fr', 'en', 'es'])}/{rng.randrange(100)}{rng.choice(['', '.html', '?ref=x&q', '#top'])}")
    return out


def test_against_brute_force(spark, urls):
    rng = random.Random(7)
    labelled = [(u, "block" if "win." in u and "/de/" in u or "shop.test" in u and "html" in u else rng.choice(["allow"] * 9 + ["block", None])) for u in urls * 2] + [(None, "block"), ("plain", "allow")]
    rows = [*enumerate(urls), (3, urls[3]), (500, None), (501, ""), (502, "plain"), (503, "x://org"), (504, "http://q.org/?a"), (505, "HTTP://EXAMPLE.org/en/1x"), (506, "http://Ünï.org/ß"), (None, "://example.org/es/"), (507, "http://a.b/" + "long/" * 3000), (508, "http://example.org:80/es/"), (509, "a://b://example.org/es/")]
    marks = spark.createDataFrame(labelled, "url string, label string")
    mined = brute_rules(labelled, 0.05, 0.8)
    got_rules = mine_rules(spark.createDataFrame([(sorted(tokens(u)), v) for u, v in labelled], "tokens array<string>, label string"), 0.05, 0.8).collect()
    assert {(tuple(r["tokens"]), r["verdict"]): (pytest.approx(r["confidence"]), pytest.approx(r["support"])) for r in got_rules} == mined
    assert any(v == "block" and len(x) == 2 for x, v in mined)  # combinations, not single tokens only
    want = []
    for i, u in rows:
        host, path = host_path(u)
        rule, verdict = explicit(host, path, RULES)
        fires = [(*y, len(x), v) for (x, v), y in mined.items() if set(x) <= tokens(u)]
        want.append((i, host, path, rule, verdict or (max(fires)[-1] if fires else "allow")))
    got = judge_urls(pages(spark, rows), marks, support=0.05, confidence=0.8).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {"block", "allow"} <= {v for *_, r, v in want if r is None}


def test_explicit_rules(spark):
    rows = [(100, "https://EXAMPLE.org/en/1x"), (101, "https://a.example.org/en/2"), (102, "https://notexample.org/es/"), (103, None), (104, "plain"), (105, "x://org")]
    got = {r["page_id"]: tuple(r)[1:] for r in judge_urls(pages(spark, rows)).collect()}
    assert got[100] == ("example.org", "/en/1x", "example.org/en/1", "block") and got[101] == ("a.example.org", "/en/2", "org/", "allow")
    assert got[102] == ("notexample.org", "/es/", "org/", "allow") and got[103] == got[104] == ("", "", None, "allow") and got[105] == ("org", "", None, "allow")


def test_nothing_to_judge_or_to_learn(spark, urls):
    none = spark.createDataFrame([], "url string, label string")
    assert judge_urls(pages(spark, []), none).collect() == []
    assert {r["verdict"] for r in judge_urls(pages(spark, [(1, "http://a.net/")]), none, rules=(), default="block").collect()} == {"block"}
