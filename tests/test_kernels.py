import itertools
import math

import numpy as np
import pytest

from simloom.functions.series import assignment, dtw, dtw_many, interpolated_distance, normalised


def plain_dtw(a, b, w, window):
    n, m = len(a), len(b)
    band = max(window if window > 0 else max(n, m), abs(n - m))
    total = np.full((n + 1, m + 1), math.inf)
    total[0, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(i - j) <= band:
                total[i, j] = math.sqrt((w * (a[i - 1] - b[j - 1]) ** 2).sum()) + min(total[i - 1, j], total[i, j - 1], total[i - 1, j - 1])
    i, j, length = n, m, 0
    while i and j:
        length += 1
        moves = [(total[i - 1, j - 1], 0, i - 1, j - 1), (total[i - 1, j], 1, i - 1, j), (total[i, j - 1], 2, i, j - 1)]
        i, j = min(moves)[2:]
    return total[n, m], length + i + j


@pytest.mark.parametrize("n,m,window", [(1, 1, 0), (1, 7, 0), (5, 9, 2), (12, 3, 1), (20, 20, 4), (8, 8, 0)])
def test_dtw_is_the_plain_recurrence(n, m, window):
    rng = np.random.default_rng(n * m)
    a, b, w = rng.normal(size=(n, 3)), rng.normal(size=(m, 3)), np.array([1.0, 0.5, 2.0])
    far, length = dtw(a, b, w, window)
    want, steps = plain_dtw(a, b, w, window)
    assert far == pytest.approx(want) and length == steps


def test_dtw_with_ties_and_of_many_pairs():
    rng = np.random.default_rng(3)
    w = np.array([1.0, 2.0])
    for n, m, window in ((6, 6, 0), (9, 4, 2), (1, 5, 1), (7, 10, 3)):
        a, b = rng.integers(0, 2, (40, n, 2)).astype(float), rng.integers(0, 2, (40, m, 2)).astype(float)
        far, length = dtw_many(a, b, w, window)
        assert [(pytest.approx(x), y) for x, y in (plain_dtw(a[k], b[k], w, window) for k in range(40))] == list(zip(far.tolist(), length.tolist()))


def test_dtw_of_long_series_in_a_narrow_band():
    x = np.cumsum(np.random.default_rng(1).normal(size=(6000, 3)), axis=0)
    assert dtw(x, x, np.ones(3), 20) == (0.0, 6000)


def test_dtw_of_an_empty_series():
    assert dtw(np.zeros((0, 2)), np.ones((3, 2)), np.ones(2)) == (math.inf, 0)


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 6)), 6
    cost = rng.normal(size=(n, m))
    columns = assignment(cost)
    assert len(set(columns.tolist())) == n
    best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
    assert cost[np.arange(n), columns].sum() == pytest.approx(best)


def test_normalised_edges():
    one = np.array([[3.0, 4.0]])
    assert np.array_equal(normalised(one), one) and np.array_equal(normalised(np.array([[np.nan, -np.inf]])), np.zeros((1, 2)))
    assert normalised(one, "none") is one
    flat = normalised(np.array([[1.0, np.nan], [1.0, np.inf], [1.0, 2.0]]))
    assert np.allclose(flat[:, 0], 0) and np.isfinite(flat).all()
    with pytest.raises(ValueError):
        normalised(np.zeros((3, 1)), "other")


def test_interpolated_distance():
    a = np.array([[0.0], [1.0]])
    assert interpolated_distance(a, a, np.ones(1)) == 0
    assert interpolated_distance(a, np.array([[0.0], [0.5], [1.0]]), np.ones(1)) == pytest.approx(0)
    assert interpolated_distance(np.zeros((0, 1)), a, np.ones(1)) == math.inf


def test_interpolated_distances_of_pairs(spark):
    from simloom.operators.trajectory import interp_euclidean

    rng = np.random.default_rng(4)
    series = [None, np.zeros((0, 2))] + [rng.normal(size=(n, 2)) for n in (1, 2, 3, 17)]
    plain = [None if x is None else x.tolist() for x in series]
    rows = [(i * 10 + j, plain[i], plain[j], "x") for i in range(6) for j in range(6)]
    pairs = spark.createDataFrame(rows, "id long, states_a array<array<double>>, states_b array<array<double>>, extra string")
    for row in interp_euclidean(pairs, [2.0, 0.5], most_rows=5).collect():
        a, b = (np.zeros((0, 2)) if series[k] is None else series[k] for k in divmod(row["id"], 10))
        assert row["extra"] == "x"
        assert row["distance"] == pytest.approx(interpolated_distance(a, b, np.array([2.0, 0.5])))
