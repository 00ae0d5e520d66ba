"""Search with bounds gives what search without gives, and skips tiles where vectors lie in groups."""

import numpy as np
import pytest

from simloom.operators import pruned, similarity


def rows_of(spark, matrix, offset=0):
    return spark.createDataFrame([(offset + k, k % 5, k % 7, x) for k, x in enumerate(matrix.tolist())], "idx long, task long, grp long, v array<double>")


def grouped(n, width=16, groups=12, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    x = np.random.default_rng(99).normal(size=(groups, width))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1)[:, None]


def same(found, wanted):
    return sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.select(*found.columns).collect()))


@pytest.fixture(scope="module")
def sides(spark):
    return rows_of(spark, grouped(420, seed=1)).persist(), rows_of(spark, grouped(500, seed=2), 5000).persist()


@pytest.fixture(scope="module")
def scattered(spark):
    """Vectors without groups and of any length, copies among them: hardly a tile can be skipped."""
    x = np.random.default_rng(5).normal(size=(200, 6))
    x[50:120] = x[3]
    return rows_of(spark, x).persist()


def test_topk_skips_tiles(sides):
    found = pruned.topk(*sides, 4, rows=30)
    assert same(found, similarity.topk(*sides, 4))
    assert found._tiles.distinct().count() == found._tiles.count() < 0.4 * found._of


def test_best_pairs_skip_tiles(sides):
    for largest in (True, False):
        found = pruned.best_pairs(*sides, 9, largest, rows=30)
        assert same(found, similarity.best_pairs(*sides, 9, largest))
        assert found._tiles.count() < 0.6 * found._of
    found = pruned.best_pairs(sides[0], sides[0], 9, within=True, rows=30)
    assert same(found, similarity.best_pairs(sides[0], sides[0], 9, within=True))
    assert found._tiles.count() < 0.75 * found._of
    assert same(pruned.best_pairs(*sides, 9, least=0.97, rows=30), similarity.best_pairs(*sides, 9, least=0.97))


def test_threshold_pairs_skip_tiles(sides):
    found = pruned.threshold_pairs(*sides, 0.97, -0.6, rows=30)
    assert same(found, similarity.threshold_pairs(*sides, 0.97, -0.6))
    assert found._tiles.count() < 0.4 * found._of


def test_no_groups(scattered):
    assert same(pruned.topk(scattered, scattered, 3, rows=40), similarity.topk(scattered, scattered, 3))
    assert same(pruned.best_pairs(scattered, scattered, 5, within=True, rows=40), similarity.best_pairs(scattered, scattered, 5, within=True))
    assert same(pruned.best_pairs(scattered, scattered, 5, False, rows=40), similarity.best_pairs(scattered, scattered, 5, False))
    assert same(pruned.threshold_pairs(scattered, scattered, 5.0, -9.0, rows=40), similarity.threshold_pairs(scattered, scattered, 5.0, -9.0))


def test_few_rows(spark, scattered):
    few, none = rows_of(spark, grouped(3, 6)), rows_of(spark, grouped(2, 6)).where("idx < 0")
    assert same(pruned.topk(few, scattered, 500, rows=40), similarity.topk(few, scattered, 500))
    assert pruned.topk(few, none, 3).collect() == [] == pruned.topk(none, few, 3).collect()
    assert pruned.best_pairs(none, scattered, 3, rows=40).collect() == [] == pruned.threshold_pairs(none, scattered, rows=40).collect()


def test_hot_centre_is_many_blocks(spark, scattered):
    blocks = pruned.near_blocks(scattered, rows=40).collect()
    assert sum(len(b["ids"]) for b in blocks) == 200 and max(len(b["ids"]) for b in blocks) < 100
    for b in blocks:
        m = np.frombuffer(b["matrix"][1:], np.float32 if b["matrix"][:1] == b"4" else np.float64).reshape(len(b["ids"]), -1)
        assert np.sqrt(((m - b["centre"]) ** 2).sum(axis=1)).max() <= b["radius"] + 1e-9
