"""Encoder heads against plain sums and the standard library's error function."""

import math

import numpy as np
import pytest

from simloom.functions.layers import erf
from simloom.operators import heads as op


def test_gelu_is_exact():
    x = np.concatenate([np.linspace(-9, 9, 2001), [0.0, 1e-300, 50.0, -50.0]])
    assert erf(x) == pytest.approx([math.erf(v) for v in x], abs=2e-15)
    assert op.gelu(x) == pytest.approx([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in x], abs=1e-14)


def test_layers_and_fusions(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(30, 4)), rng.normal(size=(30, 3))
    rows = spark.createDataFrame([(k, None if k == 4 else x.tolist(), y.tolist(), "kept") for k, (x, y) in enumerate(zip(a, b))], "idx long, a array<double>, b array<double>, vector_note string")
    first, second = op.Linear(rng.normal(size=(5, 4)), rng.normal(size=5)), op.Linear(rng.normal(size=(5, 3)), rng.normal(size=5))
    norm = op.LayerNorm(rng.normal(size=5), rng.normal(size=5))
    found = {r["idx"]: r for r in op.applied(rows, op.Fusion("weighted", op.Head([norm, op.gelu]), first, second, (0.7, 0.3)), "a", "b").collect()}
    assert found[4]["vector"] is None and found[5]["vector_note"] == "kept"
    for k in (0, 17):
        one, two = 1 / (1 + math.exp(-0.7)), 1 / (1 + math.exp(-0.3))
        x = [(one * sum(w * v for w, v in zip(first.weight[i], a[k])) + one * first.bias[i] + two * (sum(w * v for w, v in zip(second.weight[i], b[k])) + second.bias[i])) / (one + two) for i in range(5)]
        mean = sum(x) / 5
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / 5 + 1e-5)
        y = [(v - mean) / spread * s + t for v, s, t in zip(x, norm.scale, norm.shift)]
        z = [0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in y]
        assert found[k]["vector"] == pytest.approx([v / math.sqrt(sum(w * w for w in z)) for v in z])
    plain = op.applied(rows.where("idx <> 4"), op.Head([first]), "a", out="p").orderBy("idx").first()["p"]
    assert plain == pytest.approx((first.weight @ a[0] + first.bias).tolist())
    assert op.applied(rows.limit(0), op.Head([first]), "a").collect() == []


def test_what_can_not_be_applied(spark, monkeypatch):
    with pytest.raises(ValueError, match="unknown fusion"):
        op.Fusion("other", op.Head())
    with pytest.raises(ValueError, match="projection"):
        op.Fusion("add", op.Head())
    monkeypatch.setattr(op, "WEIGHT_BYTES", 10)
    with pytest.raises(ValueError, match="bytes of weights"):
        op.applied(spark.range(1), op.Head([op.Linear(np.eye(4), np.zeros(4))]), "id")
