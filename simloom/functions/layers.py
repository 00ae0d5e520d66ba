"""Activations and normalisation of vectors, as encoder heads use them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def glu(v: Column) -> Column:
    """The first half of the values, each times the sigmoid of its partner in the second half."""
    half = (F.size(v) / 2).cast("int")
    return F.zip_with(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half), lambda a, b: a / (1 + F.exp(-b)))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function of whole arrays, by its series of positive terms; beyond 6 it is 1 in eight bytes."""
    z = np.clip(np.abs(x), 0, 6)
    term = z.copy()
    total = z.copy()
    for n in range(1, 130):
        term *= 2 * z * z / (2 * n + 1)
        total += term
    return np.sign(x) * np.minimum(1.0, 2 / math.sqrt(math.pi) * np.exp(-z * z) * total)


def gelu_values(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _gelu(v: pd.Series) -> pd.Series:
    """There is no error function among Spark's own; the values of a whole batch are computed at once."""
    sizes = [0 if x is None else len(x) for x in v]
    if not sum(sizes):
        return v
    values = gelu_values(np.concatenate([x for x in v if x is not None and len(x)]).astype(float))
    parts = iter(np.split(values, np.cumsum([n for n in sizes if n])[:-1]))
    return pd.Series([x if x is None or not len(x) else next(parts) for x in v])


def gelu(v: Column) -> Column:
    return _gelu(v)


ACTIVATIONS = {"relu": relu, "gelu": gelu, "glu": glu}


def activation(v: Column, name: str) -> Column:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}: one of {', '.join(ACTIVATIONS)}")
    return ACTIVATIONS[name](v)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Mean 0 and population variance 1 over a vector's values.

    Mean and variance are found once for a vector, the variance by Welford's steps, as SQL's is.
    """
    zero = F.lit(0.0)

    def step(s, x):
        n, before = s["n"] + 1, x - s["mean"]
        mean = s["mean"] + before / n
        return F.struct(n.alias("n"), (s["total"] + x).alias("total"), mean.alias("mean"), (s["squares"] + (x - mean) * before).alias("squares"))

    start = F.struct(zero.alias("n"), zero.alias("total"), zero.alias("mean"), zero.alias("squares"))
    found = F.aggregate(v, start, step, lambda s: F.struct((s["total"] / s["n"]).alias("mean"), F.sqrt(s["squares"] / s["n"] + eps).alias("spread")))
    # a lambda's own variable is computed once, what stands inside it once for each value
    return F.get(F.transform(F.array(found), lambda s: F.transform(v, lambda x: (x - s["mean"]) / s["spread"])), F.lit(0))


def linear(v: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """``weights @ v + bias``, given row by row."""
    return F.array(*(F.aggregate(F.zip_with(v, F.lit(row), lambda x, w: x * w), F.lit(float(b)), lambda s, x: s + x) for row, b in zip(weights, bias)))
