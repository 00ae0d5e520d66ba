"""Encoder heads: projections, normalisation and fusion of two embeddings, as one matrix product for each Arrow batch.

Weights are broadcast once, behind a check of their size; no weight stands in the plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from simloom.functions.layers import gelu_values as gelu  # noqa: F401  a layer as others are

#: Most bytes of weights that are sent to every executor.
WEIGHT_BYTES = 512 << 20


@dataclass
class Linear:
    """``x @ weight.T + bias``; ``weight`` has a row for each value that comes out."""

    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias

    @property
    def nbytes(self) -> int:
        return self.weight.nbytes + self.bias.nbytes


@dataclass
class LayerNorm:
    """Mean 0 and population variance 1 of each row, then ``scale`` and ``shift``."""

    scale: np.ndarray
    shift: np.ndarray
    eps: float = 1e-5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        centred = x - x.mean(axis=-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + self.eps) * self.scale + self.shift

    @property
    def nbytes(self) -> int:
        return self.scale.nbytes + self.shift.nbytes


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Head:
    """Layers one after the other. Dropout is not there: it does nothing when a model is applied."""

    layers: list[Callable] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for layer in self.layers:
            x = layer(x)
        return x

    @property
    def nbytes(self) -> int:
        return sum(getattr(x, "nbytes", 0) for x in self.layers)


@dataclass
class Fusion:
    """Two embeddings to one: ``concat`` joins them before the head, ``add`` sums their projections, ``weighted`` by the shares of two sigmoids."""

    kind: str
    head: Head
    first: Linear | None = None
    second: Linear | None = None
    weights: tuple[float, float] = (0.7, 0.3)
    normalise: bool = True

    def __post_init__(self):
        if self.kind not in ("concat", "add", "weighted"):
            raise ValueError(f"unknown fusion {self.kind!r}: one of concat, add, weighted")
        if self.kind != "concat" and not (self.first and self.second):
            raise ValueError(f"fusion by {self.kind} needs a projection of each side")

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.kind == "concat":
            x = np.concatenate([a, b], axis=-1)
        else:
            one, two = (1 / (1 + math.exp(-w)) for w in self.weights)
            share = one / (one + two)
            p, q = (1.0, 1.0) if self.kind == "add" else (share, 1 - share)
            x = p * self.first(a) + q * self.second(b)
        x = self.head(x)
        return unit(x) if self.normalise else x

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.head, self.first, self.second) if x is not None)


def applied(rows: DataFrame, model: Head | Fusion, *columns: str, out: str = "vector") -> DataFrame:
    """``rows`` with ``out``: the model's vector of one or two vector columns; null where one of them is.

    Vectors of another width than the weights are an error.
    """
    if model.nbytes > WEIGHT_BYTES:
        raise ValueError(f"{model.nbytes} bytes of weights; {WEIGHT_BYTES} can be sent to every executor")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]):
        for part in batches:
            there = part[list(columns)].notna().all(axis=1).to_numpy()
            found = iter(sent.value(*(np.stack(part.loc[there, c].to_numpy()).astype(float) for c in columns)) if there.any() else ())
            yield part.assign(**{out: [next(found) if x else None for x in there]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, `{out}` array<double>")
