"""Mini-batch k-means over seeded batches, with restarts.

All batches of all steps are drawn in one pass: an epoch puts the rows in a seeded order and cuts it to
batches, so that a run of steps reads the collection once and then only its batches, a bounded number of rows, stored
by step. Of each step the driver sees sums and counts for each centre, and what all starts need is made in the same job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators.segments import seeded
from simloom.sources.scratch import discard, stored

BATCH, STEPS, STARTS = 4096, 100, 5
_SPACE = 1 << 48  # numbers that ``seeded`` gives


def drawn_batches(vectors: DataFrame, n: int, batch: int, steps: int, seed: int) -> DataFrame:
    """``(step, idx, v)``: rows of each step's batch, about ``batch`` each; a row comes once in an epoch."""
    per_epoch = max(1, -(-n // batch))
    epochs = -(-steps // per_epoch)
    number = lambda e: F.floor(seeded(seed, F.lit("batch"), e, F.col("idx")) / F.lit(_SPACE / per_epoch)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: e * per_epoch + number(e))
    return vectors.select(F.explode(F.filter(each, lambda s: s < steps)).alias("step"), "idx", "v")


def _first_centres(vectors: DataFrame, k: int, start: int, seed: int) -> np.ndarray:
    rows = vectors.orderBy(seeded(seed, F.lit("start"), F.lit(start), F.col("idx")), "idx").select("v").limit(k).collect()
    return np.array([r["v"] for r in rows], float)


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row (of equal ones the first), and the squared distance."""
    far = (v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1)
    at = np.round(far, 9).argmin(axis=1)
    return at, np.maximum(0, far[np.arange(len(v)), at])


def _sums(starts: list[np.ndarray]):
    """Of a part of a batch ``(start, centre, n, total)`` for each start and each centre that rows are nearest to."""

    def run(batches):
        for part in batches:
            v = np.stack(part["v"].to_numpy()).astype(float)
            for number, centres in enumerate(starts):
                at, _ = nearest(v, centres)
                used, own = np.unique(at, return_inverse=True)
                total = np.zeros((len(used), v.shape[1]))
                np.add.at(total, own, v)
                yield pd.DataFrame({"start": number, "centre": used, "n": np.bincount(own), "total": list(total)})

    return run


def moved(centres: np.ndarray, seen: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
    """Centres after a batch: each is the mean of all rows it has had so far, so that its rate falls with its count."""
    centres, seen = centres.copy(), seen.copy()
    for c, n, total in found:
        seen[c] += n
        centres[c] += (np.asarray(total) - n * centres[c]) / seen[c]
    return centres, seen


def _costs(vectors: DataFrame, starts: list[np.ndarray]) -> list[float]:
    """The sum of squared distances for each start, over all rows."""

    def run(batches):
        for part in batches:
            v = np.stack(part["v"].to_numpy()).astype(float)
            yield pd.DataFrame({"start": range(len(starts)), "cost": [nearest(v, c)[1].sum() for c in starts]})

    found = vectors.select("v").mapInPandas(run, "start int, cost double").groupBy("start").agg(F.sum("cost").alias("cost")).collect()
    return [r["cost"] for r in sorted(found)]


def fit_minibatch(vectors: DataFrame, k: int, steps: int = STEPS, batch: int = BATCH, starts: int = STARTS, seed: int = 42, least_move: float = 0.0) -> DataFrame:
    """``(cluster, center)`` of the best of ``starts`` runs of mini-batch k-means over ``(idx, v)``, by the cost over all rows.

    A start's first centres are ``k`` rows of least seeded hash. Runs end after ``steps``, or once no centre of any start has moved by more than
    ``least_move``. The driver holds the centres: ``starts`` times ``k`` vectors. The same rows give the same centres but for rounding. Fewer rows than
    ``k``: as many clusters as rows.
    """
    n = vectors.count()
    runs = [_first_centres(vectors, k, s, seed) for s in range(starts)] if n else []
    if not n:
        return vectors.sparkSession.createDataFrame([], "cluster int, center array<double>")
    seen = [np.zeros(len(c)) for c in runs]
    batches = drawn_batches(vectors, n, batch, steps, seed)
    batches = stored(batches.repartition(F.col("step")).sortWithinPartitions("step"), "kmeans-batches")
    for step in range(steps):
        parts = batches.where(F.col("step") == step).select("v").mapInPandas(_sums(runs), "start int, centre int, n long, total array<double>")
        # parts of a batch are added up by centre in the order of their size and values, whatever order they come in
        found = {}
        for r in parts.collect():
            found.setdefault(r["start"], {}).setdefault(r["centre"], []).append((r["n"], r["total"]))
        before, runs = runs, list(runs)
        for s in range(starts):
            own = [(c, sum(n for n, _ in x), np.sum(sorted(t for _, t in x), axis=0)) for c, x in found.get(s, {}).items()]
            runs[s], seen[s] = moved(runs[s], seen[s], own)
        if least_move > 0 and max(np.sqrt(((a - b) ** 2).sum(axis=1)).max() for a, b in zip(before, runs)) <= least_move:
            break
    discard(batches)
    costs = _costs(vectors, runs)
    best = runs[int(np.argmin(np.round(costs, 9)))]
    return vectors.sparkSession.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(best)], "cluster int, center array<double>")

