"""Auctions against exact assignments: equal totals on whole numbers, within the bound on others."""

import numpy as np
import pytest

from simloom.functions.series import assignment
from simloom.operators import auction as op
from simloom.operators import pairing


def rows_of(spark, *clusters):
    rows = [(c, 1000 * c + k, x) for c, matrix in enumerate(clusters) for k, x in enumerate(np.asarray(matrix, float).tolist())]
    return spark.createDataFrame(rows, "cluster int, idx long, v array<double>")


def total(found, cluster):
    own = [r for r in found if r["cluster"] == cluster]
    assert len({r["bidder"] for r in own}) == len({r["row"] for r in own}) == len(own)
    return sum(r["value"] for r in own)


def best(x, y):
    sims = x @ y.T
    return sims[np.arange(len(x)), assignment(-sims)].sum()


def test_within_the_bound(spark):
    """A square cluster and one with spare rows at once, small blocks and lists, so that claims clash and lists run out."""
    rng = np.random.default_rng(3)
    x, y, p, q = (rng.normal(size=(n, 3)) for n in (12, 12, 6, 9))
    found = op.auction(rows_of(spark, x, p), rows_of(spark, y, q), 0.02, listed=4, block=7).collect()
    assert best(x, y) - 12 * 0.02 <= total(found, 0) <= best(x, y) + 1e-9
    assert best(p, q) - 6 * 0.02 <= total(found, 1) <= best(p, q) + 1e-9


def test_whole_numbers(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 4, (8, 3)), rng.integers(0, 4, (10, 3))
    assert total(op.auction(rows_of(spark, x), rows_of(spark, y), 0.9 / 8).collect(), 0) == best(x, y)


def test_bids_keep_each_bidder_near_its_best():
    rng = np.random.default_rng(1)
    worth = rng.normal(size=(40, 50))
    lists = np.argsort(-worth, axis=1)
    price, holder = np.zeros(50), np.full(50, -1)
    stuck = op.bids(lists, np.take_along_axis(worth, lists, 1), np.full(40, -np.inf), price, holder, 1e-4)
    held = np.flatnonzero(holder >= 0)
    assert not stuck.any() and sorted(holder[held]) == list(range(40))
    own = worth[holder[held], held] - price[held]
    assert (own >= (worth - price).max(axis=1)[holder[held]] - 1e-4 - 1e-12).all()
    assert worth[holder[held], held].sum() >= worth[np.arange(40), assignment(-worth)].sum() - 40 * 1e-4
    # a list that is worth less than what may be off it
    assert op.bids(lists[:, :1], np.take_along_axis(worth, lists, 1)[:, :1], worth.max(axis=1) - 1e-9, np.zeros(50), np.full(50, -1), 1e-3).any()


def test_more_bidders_than_rows(spark):
    with pytest.raises(ValueError, match="more bidders"):
        op.auction(rows_of(spark, np.eye(3)), rows_of(spark, np.eye(3)[:2]))


def test_batches_of_large_clusters(spark, monkeypatch):
    """Clusters beyond the bound of one task give the batches that smaller ones do; either side may be the smaller one."""
    rng = np.random.default_rng(8)
    ego, tele = rows_of(spark, rng.normal(size=(13, 4)), rng.normal(size=(9, 4))), rows_of(spark, rng.normal(size=(10, 4)), rng.normal(size=(12, 4)))
    exact = sorted(map(tuple, pairing.one_to_one_batches(ego, tele, 4).collect()))
    found = sorted(map(tuple, pairing.one_to_one_batches(ego, tele, 4, most_rows=8, eps=1e-2).collect()))
    assert [r[:5] for r in found] == [r[:5] for r in exact]
    assert [r[5] for r in found] == pytest.approx([r[5] for r in exact])
