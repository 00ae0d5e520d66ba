"""Mini-batch k-means against the same seeded batches in NumPy; fallbacks."""

import hashlib

import numpy as np
import pytest

from simloom.operators import clustering as op
from simloom.operators import pairing


def seeded(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def brute(x, k, steps, batch, starts, seed):
    n = len(x)
    per_epoch = max(1, -(-n // batch))
    runs = []
    for s in range(starts):
        centres = x[sorted(range(n), key=lambda i: (seeded(seed, "start", s, i), i))[:k]].copy()
        seen = np.zeros(len(centres))
        for step in range(steps):
            epoch, number = divmod(step, per_epoch)
            own = [i for i in range(n) if int(seeded(seed, "batch", epoch, i) / ((1 << 48) / per_epoch)) == number]
            far = ((x[own][:, None] - centres) ** 2).sum(axis=2)
            at = np.round(far, 9).argmin(axis=1)
            for c in set(at.tolist()):
                rows = x[own][at == c]
                seen[c] += len(rows)
                centres[c] += (rows.sum(axis=0) - len(rows) * centres[c]) / seen[c]
        runs.append((round(float(((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum()), 9), s, centres))
    return min(runs, key=lambda r: r[:2])[2]


def rows_of(spark, x):
    return spark.createDataFrame([(k, k % 3, v) for k, v in enumerate(x.tolist())], "idx long, task long, v array<double>")


@pytest.mark.parametrize("n,k,steps,batch,starts", [(150, 4, 7, 40, 3), (30, 3, 5, 4096, 2), (3, 5, 2, 2, 1)])
def test_same_as_in_numpy(spark, n, k, steps, batch, starts):
    x = np.random.default_rng(n).normal(size=(n, 5)) + 3 * (np.arange(n) % 4)[:, None]
    found = op.fit_minibatch(rows_of(spark, x), k, steps, batch, starts, seed=7).orderBy("cluster").collect()
    assert np.array([r["center"] for r in found]) == pytest.approx(brute(x, k, steps, batch, starts, 7), abs=1e-8)


def test_no_rows_and_rest(spark):
    none = rows_of(spark, np.eye(2)).where("idx < 0")
    assert op.fit_minibatch(none, 3).collect() == []
    x = np.repeat(np.eye(3), 5, axis=0)
    assert len(op.fit_minibatch(rows_of(spark, x), 2, 50, 4, 1, least_move=10.0).collect()) == 2


def test_any_failure_falls_back(spark, monkeypatch):
    x = np.repeat(10 * np.eye(4), 10, axis=0)

    def fails(*_):
        raise RuntimeError("no")

    monkeypatch.setattr(pairing, "fit_clusters", fails)
    with pytest.warns(UserWarning, match="mini-batches"):
        found = pairing.cluster(rows_of(spark, x), 4, 10, most_dims=3).collect()
    assert len(found) == 40
    for group in range(4):
        assert len({r["cluster"] for r in found if r["idx"] // 10 == group}) == 1
