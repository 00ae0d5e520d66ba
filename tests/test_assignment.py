"""Assignments by lists against those by all costs; clusters of more rows than one task used to take."""

import numpy as np
import pytest

from simloom.functions.series import assignment
from simloom.operators import assignment as op
from simloom.operators import pairing


@pytest.mark.parametrize("alike", [1.0, 1.2, 5.0])
@pytest.mark.parametrize("kind", ["whole", "plain", "copies"])
def test_best_of_all(monkeypatch, kind, alike):
    """Short lists; with and without prices first, square and with spare columns, many ties or none."""
    monkeypatch.setattr(op, "ALIKE", alike)
    rng = np.random.default_rng(7)
    for trial in range(24):
        n, d = int(rng.integers(1, 40)), int(rng.integers(1, 6))
        m = n + int(rng.integers(0, (1, 4, 12, 40)[trial % 4]))
        few, many = (rng.integers(-2, 3, (k, d)).astype(float) if kind == "whole" else rng.normal(size=(k, d)) for k in (n, m))
        if kind == "copies":
            few[n // 2 :], many[m // 3 :] = few[0], many[0]
        found, sims = op.assigned(few, many, int(rng.integers(1, 9))), few @ many.T
        assert len(set(found.tolist())) == n
        assert sims[np.arange(n), found].sum() == pytest.approx(sims[np.arange(n), assignment(-sims)].sum(), abs=1e-9)
    with pytest.raises(ValueError, match="more rows"):
        op.assigned(np.eye(3), np.eye(3)[:2])
    assert not len(op.assigned(np.empty((0, 2)), np.eye(2)))


def test_clusters_beyond_16384_rows_need_no_auction(spark, monkeypatch):
    """Each tele row has one ego row like it; beside that cluster, two small ones."""
    monkeypatch.setattr(pairing, "auction", None)
    rng = np.random.default_rng(3)
    n = 16_400
    x = rng.normal(size=(n + 40, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order = np.append(rng.permutation(n), n + rng.permutation(40))
    cluster = np.append(np.zeros(n, int), np.repeat([1, 2], 20)).tolist()
    cluster_of = np.array(cluster)[order].tolist()
    schema = "cluster int, idx long, v array<double>"
    sides = [spark.createDataFrame(list(zip(c, range(n + 40), v.tolist())), schema) for c, v in ((cluster, x), (cluster_of, x[order]))]
    found = pairing.one_to_one_batches(*sides, 8).toPandas()
    own = found[found["cluster"] == 0]
    assert len(own) == n and (own["ego_idx"].to_numpy() == order[own["tele_idx"].to_numpy()]).all()
    assert len(found) == n + sum(min(np.bincount(np.array(cluster)[n:])[c], np.bincount(np.array(cluster_of)[n:])[c]) // 8 * 8 for c in (1, 2))
