"""Pairs are hashed, counted and chosen within their tiles, with the results of the plain ways."""

import hashlib
import math

import numpy as np
import pytest
from test_pruned import grouped, rows_of, same
from test_queries import vectors_of

from simloom.functions.hashes import pair_hashes
from simloom.operators import pairing, pruned, segments, similarity
from simloom.plans import results


@pytest.fixture(scope="module")
def sides(spark):
    return rows_of(spark, np.vstack([grouped(90, 6, spread=1.0), np.tile(grouped(1, 6), (12, 1))])).persist(), rows_of(spark, grouped(110, 6, spread=1.0, seed=2), 95).persist()


def test_hashes_of_pairs():
    i, j = np.array([0, 7, 95, 1234, 10**18, -3]), np.array([5, 99, 100, 10**15, 2**62])
    rows, columns = (x.ravel() for x in np.indices((6, 5)))
    want = [int(hashlib.md5(f"7|{i[a]}|{j[b]}".encode()).hexdigest()[:8], 16) for a, b in zip(rows, columns)]
    assert pair_hashes(7, i, j, rows, columns).tolist() == want
    assert not len(pair_hashes(7, i, j, rows[:0], columns[:0]))


@pytest.mark.parametrize("rows", [None, 16])
def test_sets_and_balanced_pairs(spark, sides, monkeypatch, rows):
    if rows:  # several tiles
        monkeypatch.setattr(pruned, "_one_tile", lambda *_: False)
        monkeypatch.setattr(pruned, "near_blocks", lambda x, n=None, f=pruned.near_blocks: f(x, rows))
        monkeypatch.setattr(pruned, "DENSE", 2.0)
    plain = similarity.threshold_pairs(*sides, 0.6, -0.2).persist()
    assert same(pairing.labelled_sets_of(*sides, 0.6, -0.2, 5, 9), pairing.labelled_sets(plain, 5, 9))
    for ratio in (0.4, 99.0):
        assert same(pairing.balanced_pairs_of(*sides, 0.6, -0.2, ratio), pairing.balanced_pairs(plain, ratio))
    assert same(pruned.threshold_pairs(*sides, 0.6, -math.inf), plain.where("label = 1"))


def test_tiles_give_few_pairs(sides):
    """A tile sorts only pairs that may be among the best, and gives the first pairs of each label only."""
    rng = np.random.default_rng(4)
    sims = rng.normal(size=(300, 400))
    ids = [np.arange(300), np.zeros(300), np.zeros(300)], [np.arange(400), np.zeros(400), np.zeros(400)]
    sorted_rows = []
    first = similarity._first
    try:
        similarity._first = lambda rows, order, k: sorted_rows.append(len(rows)) or first(rows, order, k)
        for largest in (True, False):
            got = similarity.best_pairs_kernel(10, largest, False, None)(*ids, sims, False)
            want = np.sort(np.round(sims, 9).ravel())
            assert got["sim"].tolist() == (want[::-1] if largest else want)[:10].tolist()
    finally:
        similarity._first = first
    assert max(sorted_rows) < 100


def test_dense_tiles_go_in_large_blocks(spark, sides):
    found = pruned.threshold_pairs(*sides, -2.0, -3.0, rows=16)
    assert not hasattr(found, "_tiles") and found.count() == 102 * 110
    assert same(pruned.best_pairs(*sides, 7, False, rows=16), similarity.best_pairs(*sides, 7, False))
    assert same(similarity.best_pairs(*sides, 7, False, least=0.1), similarity.threshold_pairs(*sides, 0.1, -9.0).orderBy("sim", "i", "j").limit(7).drop("label"))


def test_ranges_are_found_by_search(spark):
    rows = spark.createDataFrame([(k, float(k * 37 % 101)) for k in range(500)] + [(500, math.nan)], "idx long, x double")
    got = segments.numbered(rows, "x", "pos", "idx", block=10).orderBy("pos").collect()
    want = sorted(((k * 37 % 101, k) for k in range(500))) + [(math.nan, 500)]
    assert [(r["pos"], r["idx"]) for r in got] == [(n, k) for n, (_, k) in enumerate(want)]


def test_matched_rows_leave_no_task_out(spark):
    """Each matching task of the tables has a slot, as there are more slots than tasks."""
    rows = results.QUERIES["matched_rows"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 16 and all({r["task"] for r in rows if r["side"] == side} == {0, 1, 2, 3, 4} for side in ("ego", "tele"))


def test_clusters_beyond_4096_rows_are_assigned_in_one_task(spark, monkeypatch):
    """Each row has one like it on the other side; no auction is held for 4200 rows a side."""

    def no_auction(*_):
        raise AssertionError("an auction for a cluster that one task can assign")

    monkeypatch.setattr(pairing, "auction", no_auction)
    x = grouped(4200, 8, spread=1.0)
    order = np.random.default_rng(3).permutation(4200)
    got = pairing.one_to_one_batches(vectors_of(spark, x), vectors_of(spark, x[order]), 8).collect()
    assert len(got) == 4200 and all(order[r["tele_idx"]] == r["ego_idx"] for r in got)
