"""Queries on encoder heads; weights follow a rule, so that SQL can have the same."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from simloom.functions.vector import rounded
from simloom.operators import heads as op
from simloom.sources.tables import vectors

from .base import EGO_TELE, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
OUT, FIRST = 16, 40  # values that come out; values of the first embedding, of 64


def _linear(width: int, seed: int) -> op.Linear:
    i, j = np.arange(OUT)[:, None], np.arange(width)[None, :]
    return op.Linear(np.sin(i * 7 + j * 3 + seed) / math.sqrt(width), np.cos(np.arange(OUT) + seed) / 10)


def _norm() -> op.LayerNorm:
    return op.LayerNorm(1 + np.sin(np.arange(OUT)) / 10, np.cos(np.arange(OUT)) / 10)


def _linear_sql(x: str, width: int, seed: int) -> str:
    return f"list_transform(range(0, {OUT}), lambda i: list_dot_product({x}, list_transform(range(0, {width}), lambda j: sin(i * 7 + j * 3 + {seed}) / {math.sqrt(width)!r}::DOUBLE)) + cos(i + {seed}) / 10)"


_NORM_SQL = "list_transform(range(1, {n} + 1), lambda i: (x[i] - list_avg(x)) / sqrt(list_var_pop(x) + 1e-5::DOUBLE) * (1 + sin(i - 1) / 10) + cos(i - 1) / 10)".format(n=OUT)
#: 2^n / (1 3 5 .. (2n + 1)), the factors of the error function's series.
_SERIES = "[" + ", ".join(repr(2.0**n / math.prod(range(1, 2 * n + 2, 2))) for n in range(60)) + "]::DOUBLE[]"
_GELU_SQL = f"list_transform(x, lambda t: 0.5 * t * (1 + 2 / sqrt(pi()) * exp(-t * t / 2) * list_sum(list_transform(range(0, 60), lambda n: ({_SERIES})[n + 1] * pow(t / sqrt(2), 2 * n + 1)))))"
_SHARE = 1 / (1 + math.exp(-0.7)) / (1 / (1 + math.exp(-0.7)) + 1 / (1 + math.exp(-0.3)))


def _sum_sql(p: str, q: str) -> str:
    return f"list_transform(range(1, {OUT} + 1), lambda i: {p} * (a)[i] + {q} * (b)[i])"


@query(f"""WITH {EGO_TELE},
s AS (SELECT idx, v, {_linear_sql(f'v[1:{FIRST}]', FIRST, 2)} AS a, {_linear_sql(f'v[{FIRST + 1}:64]', 64 - FIRST, 3)} AS b FROM e),
k AS (SELECT idx, 'concat' AS kind, {_linear_sql('v', 64, 1)} AS x FROM s UNION ALL SELECT idx, 'add', {_sum_sql('1.0::DOUBLE', '1.0::DOUBLE')} FROM s UNION ALL SELECT idx, 'weighted', {_sum_sql(repr(_SHARE) + '::DOUBLE', repr(1 - _SHARE) + '::DOUBLE')} FROM s),
n AS (SELECT idx, kind, {_NORM_SQL} AS x FROM k), g AS (SELECT idx, kind, {_GELU_SQL} AS x FROM n),
o AS (SELECT idx, kind, CASE WHEN kind = 'concat' THEN {_linear_sql('x', OUT, 4)} ELSE x END AS x FROM g)
SELECT idx, kind, list_transform(x, lambda t: round(t / greatest(sqrt(list_dot_product(x, x)), 1e-12::DOUBLE), 6)) AS vector FROM o""")
def fusion_heads(spark, d):
    """Each segment's vector, its first 40 and last 24 values as two embeddings, fused in three ways."""
    rows = vectors(spark, d).select("idx", F.slice("v", 1, FIRST).alias("a"), F.slice("v", FIRST + 1, 64 - FIRST).alias("b"))
    tail, sides = op.Head([_norm(), op.gelu]), (_linear(FIRST, 2), _linear(64 - FIRST, 3))
    models = {"concat": op.Fusion("concat", op.Head([_linear(64, 1), _norm(), op.gelu, _linear(OUT, 4)])), "add": op.Fusion("add", tail, *sides), "weighted": op.Fusion("weighted", tail, *sides)}
    out = None
    for kind, model in models.items():
        part = op.applied(rows, model, "a", "b").select("idx", F.lit(kind).alias("kind"), F.transform("vector", lambda x: rounded(x, 6)).alias("vector"))
        out = part if out is None else out.unionByName(part)
    return out
