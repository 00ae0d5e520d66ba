"""Trajectories: state vectors by frame, normalisation, distances of pairs, summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.series import dtw_many, interpolated_distance, mean_in_order, normalised, rounded, weighted_length
from simloom.functions.vector import clean
from simloom.operators.quantiles import quantile_columns
from simloom.sources.scratch import stored

# The state columns of the recordings, their widths and weights.
PARTS = (
    ("leftarm_state_cart_pos", 6, 1.0),
    ("rightarm_state_cart_pos", 6, 1.0),
    ("torso_state_cart_pos", 6, 0.3),
    ("leftarm_gripper_state_pos", 1, 0.5),
    ("rightarm_gripper_state_pos", 1, 0.5),
    ("base_state_speed", 3, 0.2),
)


def state_vector(parts: list[tuple[Column, int]]) -> Column:
    """The parts one after the other, each padded with zeros or cut to its width; null if a part is."""
    fixed = [F.slice(F.concat(a, F.array_repeat(F.lit(0.0), w)), 1, w) for a, w in parts]
    return F.when(~F.greatest(*(a.isNull() for a, _ in parts), F.lit(False)), F.concat(*fixed))


def weight_vector(parts: tuple = PARTS) -> list[float]:
    return [w for _, n, w in parts for _ in range(n)]


def trajectories(frames: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """``(key, n_frames, states)``: a segment's state vectors in frame order; frames without one are skipped."""
    rows = frames.select(key, F.col(order).alias("at"), state.alias("state")).where("state IS NOT NULL")
    return rows.groupBy(key).agg(F.count("*").alias("n_frames"), F.transform(F.sort_array(F.collect_list(F.struct("at", "state"))), lambda x: x["state"]).alias("states"))


def extract(segments: DataFrame, frames: DataFrame, state: Column) -> DataFrame:
    """Trajectories of ``segments`` ``(seg, episode, frame_indices)`` in the order of their frame lists; frames that do not exist are skipped."""
    wanted = segments.select("seg", "episode", F.posexplode("frame_indices").alias("at", "frame"))
    return trajectories(wanted.join(frames, ["episode", "frame"]), "seg", "at", state)


def scaled(frames: DataFrame, key: str, columns: list[str], how: str = "zscore") -> DataFrame:
    """Columns normalised within each segment: population z-score or min-max; spreads under 1e-8 count as 1, segments of one frame stay."""
    whole = Window.partitionBy(key)
    out = frames.withColumns({c: clean(F.col(c)) for c in columns})
    n = F.count("*").over(whole)
    new = {}
    for c in columns:
        x = F.col(c)
        low, spread = (F.avg(x).over(whole), F.stddev_pop(x).over(whole)) if how == "zscore" else (F.min(x).over(whole), F.max(x).over(whole) - F.min(x).over(whole))
        new[c] = F.when(n < 2, x).otherwise((x - low) / F.when(spread < 1e-8, F.lit(1.0)).otherwise(spread))
    return out.withColumns(new)


def compare(pairs: DataFrame, weights: list[float], how: str = "zscore", window_ratio: float = 0.2, size: int = 100, most_values: int = 1 << 21) -> DataFrame:
    """Distances of the trajectories ``states_a`` and ``states_b`` of each pair.

    Adds ``interp_distance``, ``dtw_distance``, ``dtw_path``, ``dtw_normalised``, ``len_a``, ``len_b``
    and ``dim``. With a missing or empty trajectory the distances are infinite and the rest is 0. Pairs
    of a batch with the same two lengths are compared at once, as many as hold ``most_values`` values. A state with
    more or fewer values than there are weights, or none at all, is an error.
    """
    w = np.array(weights)
    new = ("interp_distance", "dtw_distance", "dtw_path", "dtw_normalised", "len_a", "len_b", "dim")

    def series(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        states = column.flatten()
        if not pc.all(pc.equal(states.value_lengths(), len(w)), skip_nulls=False, min_count=0).as_py():
            raise ValueError(f"a state without {len(w)} values, one for each weight")
        flat = states.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(w))
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return flat, length, np.cumsum(length) - length

    def run(batches):
        for batch in batches:
            (a, n, at_a), (b, m, at_b) = (series(batch.column(batch.schema.get_field_index(c))) for c in ("states_a", "states_b"))
            rows = len(n)
            out = {c: np.full(rows, math.inf) for c in ("interp_distance", "dtw_distance", "dtw_normalised")} | {c: np.zeros(rows, np.int64) for c in ("dtw_path", "len_a", "len_b", "dim")}
            use = np.flatnonzero((n > 0) & (m > 0))
            use = use[np.lexsort((m[use], n[use]))]
            cuts = np.flatnonzero(np.diff(n[use]) | np.diff(m[use])) + 1
            for same in np.split(use, cuts) if len(use) else ():
                k, l = int(n[same[0]]), int(m[same[0]])
                step = max(1, most_values // ((k + l + size) * len(w)))
                for own in (same[i : i + step] for i in range(0, len(same), step)):
                    x, y = (normalised(flat[at[own][:, None] + np.arange(size_)], how) for flat, at, size_ in ((a, at_a, k), (b, at_b, l)))
                    out["dtw_distance"][own], out["dtw_path"][own] = dtw_many(x, y, w, int(max(k, l) * window_ratio))
                    out["dtw_normalised"][own] = out["dtw_distance"][own] / np.maximum(out["dtw_path"][own], 1)
                    out["interp_distance"][own] = interpolated_distance(x, y, w, size)
                    out["len_a"][own], out["len_b"][own], out["dim"][own] = k, l, len(w)
            out |= {c: rounded(out[c], 6) for c in ("interp_distance", "dtw_distance", "dtw_normalised")}
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *(pa.array(out[c]) for c in new)], [*(f.name for f in kept), *new])

    kept = [f for f in pairs.schema.fields if f.name not in ("states_a", "states_b")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {'double' if c.startswith(('interp', 'dtw_d', 'dtw_n')) else 'long'}" for c in new)])
    return pairs.mapInArrow(run, schema)


def _places(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``size`` evenly spread moments in series of each length: the frame before, the one after, and the part between."""
    at = np.arange(size) * (length[:, None] - 1) / (size - 1)
    low = np.minimum(at.astype(np.int64), np.maximum(length[:, None] - 2, 0))
    return low, np.minimum(low + 1, length[:, None] - 1), (at - low)[:, :, None]


def interp_euclidean(pairs: DataFrame, weights: list[float], size: int = 100, most_rows: int = 1024) -> DataFrame:
    """``pairs`` with ``distance`` in place of ``states_a`` and ``states_b``: the interpolated distance.

    All pairs of a slice of ``most_rows`` are computed at once on flat Arrow arrays. A missing or
    empty trajectory is infinitely far; states must have as many values as there are weights.
    """
    w = np.array(weights)

    def moments(column: pa.Array, use: np.ndarray) -> np.ndarray:
        states = column.flatten()
        flat = states.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(w))
        length = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = (np.cumsum(length) - length)[use][:, None]
        low, high, part = _places(length[use], size)
        return flat[first + low] * (1 - part) + flat[first + high] * part

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, most_rows):
                rows = batch.slice(at, most_rows)
                a, b = (rows.column(rows.schema.get_field_index(c)) for c in ("states_a", "states_b"))
                use = np.logical_and(*((x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0) for x in (a, b)))
                distance = np.full(rows.num_rows, math.inf)
                if use.any():
                    gap = moments(a, use) - moments(b, use)
                    distance[use] = mean_in_order(weighted_length(gap, w))
                names = [c for c in rows.schema.names if c not in ("states_a", "states_b")]
                yield pa.record_batch([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(distance)], [*names, "distance"])

    kept = [f for f in pairs.schema.fields if f.name not in ("states_a", "states_b")]
    return pairs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "distance double"]))


def summary(results: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, deviation, least, largest, median and quartiles of each metric over its finite values; ``error`` rows are counted apart."""
    pieces = []
    valid = F.col("error").isNull()
    finite = {name: F.when(valid & (F.col(name) != float("inf")), F.col(name)) for name in metrics}
    results = stored(results.select("error", *(finite[name].alias(name) for name in metrics)), "metrics")
    for name in metrics:
        x = F.col(name)
        low, mid, high = quantile_columns(results, name, [0.25, 0.5, 0.75])
        pieces.append(F.struct(F.lit(name).alias("metric"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.min(x), 6).alias("least"), F.round(F.max(x), 6).alias("largest"), F.round(mid, 6).alias("median"), F.round(low, 6).alias("p25"), F.round(high, 6).alias("p75"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_error"), F.count("*").alias("n_total")))
    return results.agg(F.array(*pieces).alias("x")).select(F.inline("x"))


def correlation(results: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over finite rows; null for two rows or fewer."""
    use = results.where(F.col("error").isNull() & (F.col(a) != float("inf")) & (F.col(b) != float("inf")))
    return use.agg(F.count("*").alias("n"), F.when(F.count("*") > 2, F.round(F.corr(a, b), 6)).alias("corr"))
