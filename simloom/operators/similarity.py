"""Similarity of two vector collections: statistics, top-k, pairs.

Vectors are packed to blocks; each pair of blocks, a tile, is one row of an equi-join and a few matrix
products in NumPy. No pair of single rows is ever shuffled: a tile gives its statistics, its counts,
or the best ``k`` of each of its queries, and those are merged.

A block is sent once to each block of the other side, so blocks are as large as ``BLOCK_BYTES`` lets
them be, but for as many tiles as make work for all cores. Within a tile, ``TILE`` rows meet ``TILE``
rows at a time, which bounds the products.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.series import rounded
from simloom.functions.vector import dot

BLOCK_BYTES, TILE = 64 << 20, 2048
#: More than what bounds can be off by, as they and products are rounded.
SLACK = 1e-7
LABELLED = "i long, j long, sim double, label int"
_BLOCK_SQL = "block int, ids array<long>, tasks array<long>, groups array<long>, matrix binary"


def _cores(rows: DataFrame) -> int:
    return rows.sparkSession.sparkContext.defaultParallelism


def block_of(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """One block's row out of its vectors' rows, and their matrix."""
    rows = rows.sort_values("idx")
    matrix = np.stack(rows["v"].to_numpy()).astype(np.float64)
    short = matrix.astype(np.float32)
    raw = b"4" + short.tobytes() if np.array_equal(short, matrix) else b"8" + matrix.tobytes()
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "ids": [rows["idx"].tolist()], "tasks": [rows["task"].tolist()], "groups": [rows["grp"].tolist()], "matrix": [raw]}), matrix


def block_rows(vectors: DataFrame) -> tuple[int, int]:
    """How many vectors there are, and how many to put into a block."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    most = max(TILE, BLOCK_BYTES // (4 * max(1, size["width"] or 1)))
    return size["n"], min(most, max(TILE, math.ceil(size["n"] / math.ceil(math.sqrt(2 * _cores(vectors))))))


def packed(vectors: DataFrame, within: str | None = None) -> DataFrame:
    """Rows ``(idx, task, grp, v)`` as blocks, dealt by hash of ``idx``; ``within``: a column of which each value has blocks of its own.

    Values are kept in four bytes where that loses nothing.
    """
    n, rows = block_rows(vectors)

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out, _ = block_of(rows)
        return out if within is None else out.assign(own=[rows["own"].iloc[0]])

    if within is None:
        blocks = -(-n // rows)
        dealt = vectors.select("idx", "task", "grp", "v", F.pmod(F.xxhash64("idx"), F.lit(max(1, blocks))).cast("int").alias("block"))
        out = dealt.groupBy("block").applyInPandas(pack, _BLOCK_SQL)
        out._blocks = blocks  # so that they need not be counted
        return out
    parts = vectors.groupBy(within).agg(F.ceil(F.count("*") / rows).alias("parts"))
    dealt = vectors.join(parts, within).select("idx", "task", "grp", "v", F.col(within).alias("own"), F.pmod(F.xxhash64("idx"), "parts").cast("int").alias("block"))
    return dealt.groupBy("own", "block").applyInPandas(pack, f"{_BLOCK_SQL}, own {vectors.schema[within].dataType.simpleString()}")


def tiles(a: DataFrame, b: DataFrame, kernel: Callable, schema: str, half: bool = False, merge: Callable | None = None, chosen: DataFrame | None = None, sign: int = 1, digits: int | None = None) -> DataFrame:
    """``kernel(x, y, sims, own)`` on the pieces of each pair of blocks, as ``packed`` makes them.

    ``x`` and ``y`` are ``(ids, tasks, groups)``. ``half``: of one collection with itself, each pair of
    pieces once; ``own`` tells that a piece meets itself, its ids rising. ``merge`` makes one frame of
    those of one piece of ``x`` with all of ``y``. Blocks made within a column meet those of the same
    value only. ``chosen``: the blocks ``(i, j, floor)`` that meet, in place of all; the blocks of ``b`` then have a ``centre`` and
    a ``radius``, and rows of ``i`` of which no product with a row of ``j``, times ``sign``, can reach ``floor`` are left out.
    ``digits``: ``sims`` come rounded to so many, as ``rounded_products`` does.
    """
    left, right = (x.select(*(F.col(c).alias(f"{side}_{c}") for c in x.columns)) for side, x in (("a", a), ("b", b)))
    if chosen is not None:
        left = left.join(chosen, F.col("a_block") == F.col("i")).repartition("i", "j")
        right = right.join(chosen.select("i", "j"), F.col("b_block") == F.col("j")).repartition("i", "j")
        pairs = left.join(right.hint("merge"), ["i", "j"]).drop("i", "j")
    elif "own" in a.columns:
        pairs = left.join(right, F.col("a_own") == F.col("b_own")).repartition("a_own", "a_block", "b_block")
    else:
        n, m = a._blocks, b._blocks
        if not n or not m:
            return a.sparkSession.createDataFrame([], schema)
        low, high = (F.col("a_block"), F.col("b_block")) if half else (F.lit(0), F.lit(n - 1))
        left = left.select("*", F.col("a_block").alias("i"), F.explode(F.sequence(low, F.lit(m - 1))).alias("j")).repartition(min(n * m, 4096), "i", "j")
        right = right.select("*", F.col("b_block").alias("j"), F.explode(F.sequence(F.lit(0), high)).alias("i")).repartition(min(n * m, 4096), "i", "j")
        pairs = left.join(right.hint("merge"), ["i", "j"]).drop("i", "j")

    bounded = chosen is not None

    def side(row, name):
        ids, raw = np.asarray(row[f"{name}_ids"]), row[f"{name}_matrix"]
        matrix = np.frombuffer(raw, np.float32 if raw[:1] == b"4" else np.float64, offset=1)
        return (ids, np.asarray(row[f"{name}_tasks"]), np.asarray(row[f"{name}_groups"])), matrix.reshape(len(ids), -1)

    def run(batches):
        for rows in batches:
            for _, row in rows.iterrows():
                (x, left), (y, right) = side(row, "a"), side(row, "b")
                same = half and row["a_block"] == row["b_block"]
                if bounded and not same:
                    wide = left.astype(np.float64)
                    reach = sign * (wide @ np.asarray(row["b_centre"])) + np.linalg.norm(wide, axis=1) * row["b_radius"]
                    may = reach >= row["floor"] - SLACK
                    x, left = tuple(c[may] for c in x), left[may]
                for k in range(0, len(left), TILE):
                    part, found = left[k : k + TILE].astype(np.float64), []
                    for j in range(k if same else 0, len(right), TILE):
                        other = right[j : j + TILE].astype(np.float64)
                        sims = part @ other.T
                        if digits is not None:
                            sims = rounded_products(part, other, sims, digits)
                        found.append(kernel([c[k : k + TILE] for c in x], [c[j : j + TILE] for c in y], sims, same and j == k))
                        if not merge:
                            yield found.pop()
                    if found:
                        yield merge(pd.concat(found, ignore_index=True))

    return pairs.mapInPandas(run, schema)


def rounded_products(x: np.ndarray, y: np.ndarray, sims: np.ndarray, digits: int) -> np.ndarray:
    """``sims``, the products of all rows of ``x`` and ``y``, rounded as SQL rounds its own.

    A matrix product adds up in another order. Only where that could matter, next to a half and for the
    sign of zero, products are added up again in the order of the values, as SQL does; to the last bit if
    values are of four bytes, whose products are exact, fused with the sum or not.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = sims * 10.0**digits
        whole = np.rint(scaled)
        off = 2 * (x.shape[1] + 2) * np.finfo(float).eps * np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(y, axis=1).max(initial=0) * 10.0**digits
        i, j = np.nonzero(~(np.abs(scaled - whole) < 0.5 - off) | (np.abs(scaled) <= off))
        total = np.zeros(len(i))
        for k in range(x.shape[1]):
            total += x[i, k] * y[j, k]
        whole /= 10.0**digits
    whole[i, j] = rounded(total, digits)
    return whole


def cross_stats(ego: DataFrame, tele: DataFrame, by_task: bool = False) -> DataFrame:
    """Largest, smallest, mean and population deviation over all pairs, or by whether the tasks agree."""

    def kernel(x, y, sims, own):
        same = x[1][:, None] == y[1][None, :]
        parts = [(flag, sims[same == flag]) for flag in (True, False)] if by_task else [(None, sims.ravel())]
        rows = [(flag, *_moments(s)) for flag, s in parts if s.size]
        return pd.DataFrame(rows, columns=["same_task", *_MOMENTS])

    parts = tiles(packed(ego), packed(tele), kernel, f"same_task boolean, {_MOMENTS_SQL}")
    return _merged(parts, "same_task") if by_task else _merged(parts)


_MOMENTS = ("n", "high", "low", "s1", "s2")
_MOMENTS_SQL = "n long, high double, low double, s1 double, s2 double"


def _moments(s: np.ndarray) -> tuple:
    return s.size, s.max(), s.min(), s.sum(), (s * s).sum()


def _merged(parts: DataFrame, *by: str) -> DataFrame:
    n, s1, s2 = F.sum("n"), F.sum("s1"), F.sum("s2")
    spread = F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s1 / n) * (s1 / n)))
    return parts.groupBy(*by).agg(n.alias("n_pairs"), F.round(F.max("high"), 6).alias("max_sim"), F.round(F.min("low"), 6).alias("min_sim"), F.round(s1 / n, 6).alias("mean_sim"), F.round(spread, 6).alias("std_sim"))


def self_stats(vectors: DataFrame) -> DataFrame:
    """The same over all unordered pairs of different rows; each pair of blocks is taken once."""

    def kernel(x, y, sims, own):
        s = sims[np.triu_indices(len(sims), 1)] if own else sims.ravel()
        return pd.DataFrame([_moments(s)] if s.size else [], columns=_MOMENTS)

    blocks = packed(vectors)
    return _merged(tiles(blocks, blocks, kernel, _MOMENTS_SQL, half=True))


def cluster_stats(ego: DataFrame, tele: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The same over the pairs within each cluster: ``(cluster, n_pairs, max_sim, min_sim, mean_sim, std_sim)``."""
    blocks = [packed(x.withColumn("grp", F.col(cluster).cast("long")), cluster) for x in (ego, tele)]

    def kernel(x, y, sims, own):
        return pd.DataFrame([(x[2][0], *_moments(sims))], columns=[cluster, *_MOMENTS])

    kind = ego.schema[cluster].dataType.simpleString()
    return _merged(tiles(*blocks, kernel, f"`{cluster}` long, {_MOMENTS_SQL}").withColumn(cluster, F.col(cluster).cast(kind)), cluster)


def topk_parts(k: int) -> tuple[Callable, Callable, str]:
    """What ``tiles`` needs for the best ``k`` of each row."""

    def kernel(x, y, sims, own):
        sims = np.round(sims, 9)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]  # y's ids rise
        rows, cols = np.repeat(np.arange(len(x[0])), best.shape[1]), best.ravel()
        return pd.DataFrame({"query_idx": x[0][rows], "query_task": x[1][rows], "match_idx": y[0][cols], "match_task": y[1][cols], "sim": sims[rows, cols]})

    def merge(found):
        return found.sort_values(["query_idx", "sim", "match_idx"], ascending=[True, False, True]).groupby("query_idx").head(k)

    return kernel, merge, "query_idx long, query_task long, match_idx long, match_task long, sim double"


def ranked(near: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query among those of its tiles."""
    rank = F.row_number().over(Window.partitionBy("query_idx").orderBy(F.desc("sim"), "match_idx"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("same_task", F.col("query_task") == F.col("match_task"))


def topk(ego: DataFrame, tele: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most similar tele rows of each ego row; ties (to 9 decimals) by index. ``tele`` may come in blocks already."""
    kernel, merge, schema = topk_parts(k)
    return ranked(tiles(packed(ego), tele if "matrix" in tele.columns else packed(tele), kernel, schema, merge=merge), k)


def best_pairs_kernel(k: int, largest: bool, within: bool, least: float | None) -> Callable:
    """Only pairs that may be among the best are rounded and sorted: as many rows as are wanted have a pair of the floor or better."""

    def kernel(x, y, sims, own):
        worth = sims if largest else -sims
        use = None
        if within or own:
            use = x[2][:, None] != y[2][None, :] if within else np.ones(sims.shape, bool)
            use = np.triu(use, 1) if own else use
        if least is not None and not largest:
            use = np.round(sims, 9) >= least if use is None else use & (np.round(sims, 9) >= least)
        if use is not None:
            worth = np.where(use, worth, -np.inf)
        best = worth.max(axis=1, initial=-np.inf)
        floor = np.partition(best, -k)[-k] - SLACK if len(best) > k > 0 else -np.inf
        if least is not None and largest:
            floor = max(floor, least - SLACK)
        i, j = np.nonzero((worth >= floor) & (worth > -np.inf))
        s = np.round(sims[i, j], 9)
        if least is not None:
            i, j, s = i[s >= least], j[s >= least], s[s >= least]
        first, second = x[0][i], y[0][j]
        if within:
            first, second = np.minimum(first, second), np.maximum(first, second)
        return _first(pd.DataFrame({"i": first, "j": second, "sim": s}), (second, first, -s if largest else s), k)

    return kernel


def best_pairs(a: DataFrame, b: DataFrame, k: int, largest: bool = True, within: bool = False, least: float | None = None) -> DataFrame:
    """The ``k`` most (or least) similar pairs overall; ``within``: of one collection, i < j and different groups; ``least``: of those from it on."""
    blocks = packed(a)
    found = tiles(blocks, blocks if within else packed(b), best_pairs_kernel(k, largest, within, least), "i long, j long, sim double", half=within)
    return found.orderBy(F.desc("sim") if largest else F.asc("sim"), "i", "j").limit(k)


def first_pairs(a: DataFrame, b: DataFrame, k: int, least: float) -> DataFrame:
    """The first ``k`` pairs in the order of their indexes, of those with a similarity of ``least`` or more."""

    def kernel(x, y, sims, own):
        sims = np.round(sims, 9)
        i, j = np.nonzero(sims >= least)
        return _first(pd.DataFrame({"i": x[0][i], "j": y[0][j], "sim": sims[i, j]}), (y[0][j], x[0][i]), k)

    return tiles(packed(a), packed(b), kernel, "i long, j long, sim double").orderBy("i", "j").limit(k)


def _first(rows: pd.DataFrame, order: tuple, k: int) -> pd.DataFrame:
    return rows.iloc[np.lexsort(order)[:k]]


def band_counts(a: DataFrame, b: DataFrame, bands: list[tuple[str, float]], colours: list[tuple[str, float]], positive: float, negative: float) -> DataFrame:
    """``(band, colour, n)`` of the labelled pairs, counted in the tiles.

    ``bands`` and ``colours`` name ranges from the highest down: a band begins at its bound, a colour
    above it; the last of each needs none.
    """

    def kernel(x, y, sims, own):
        s = np.round(sims, 9).ravel()
        s = s[(s >= positive) | (s <= negative)]
        band = np.select([s >= bound for _, bound in bands[:-1]], range(len(bands) - 1), len(bands) - 1)
        colour = np.select([s > bound for _, bound in colours[:-1]], range(len(colours) - 1), len(colours) - 1)
        both, n = np.unique(band * len(colours) + colour, return_counts=True)
        names = [(bands[x // len(colours)][0], colours[x % len(colours)][0]) for x in both.tolist()]
        return pd.DataFrame(names, columns=["band", "colour"], dtype=object).assign(n=n)

    return tiles(packed(a), packed(b), kernel, "band string, colour string, n long").groupBy("band", "colour").agg(F.sum("n").alias("n"))


def pair_histogram(a: DataFrame, b: DataFrame, bins: int, positive: float = -math.inf, negative: float = math.inf) -> DataFrame:
    """``(bin, n)`` of the pairs from ``positive`` on or up to ``negative`` (all, if not given), in equal bins from the least to the largest.

    The ends are found in a first pass over the tiles, the counts in a second; the largest value
    belongs to the last bin. No pair leaves its tile.
    """

    def chosen(sims):
        s = np.round(sims, 9).ravel()
        return s[(s >= positive) | (s <= negative)]

    def ends(x, y, sims, own):
        s = chosen(sims)
        return pd.DataFrame({"low": [s.min()], "high": [s.max()]} if len(s) else {"low": [], "high": []})

    blocks = packed(a), packed(b)
    found = tiles(*blocks, ends, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    low, width = found["low"], ((found["high"] - found["low"]) / bins if found["low"] is not None else None)

    def kernel(x, y, sims, own):
        s = chosen(sims)
        number = np.minimum(np.floor((s - low) / width), bins - 1) if width else np.zeros(len(s))
        found, n = np.unique(number.astype(np.int32), return_counts=True)
        return pd.DataFrame({"bin": found, "n": n})

    return tiles(*blocks, kernel, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def search(index: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` rows of ``index`` with the largest dot product; of ties the later row."""
    sim = F.round(dot(F.col("v"), F.array(*map(F.lit, query))), 9)
    return index.select("idx", "task", sim.alias("sim")).orderBy(F.desc("sim"), F.desc("idx")).limit(k)


def labelled(sims: np.ndarray, positive: float, negative: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and similarities, to 9 decimals, of a piece's pairs from ``positive`` on or up to ``negative``; only near those bounds or beyond are any rounded."""
    i, j = np.nonzero((sims >= positive - SLACK) | (sims <= negative + SLACK))
    s = np.round(sims[i, j], 9)
    use = (s >= positive) | (s <= negative)
    return (i, j, s) if use.all() else (i[use], j[use], s[use])


def threshold_kernel(positive: float, negative: float) -> Callable:
    def kernel(x, y, sims, own):
        i, j, s = labelled(sims, positive, negative)
        return pd.DataFrame({"i": x[0][i], "j": y[0][j], "sim": s, "label": (s >= positive).astype(np.int32)})

    return kernel


def threshold_pairs(a: DataFrame, b: DataFrame, positive: float = 0.85, negative: float = 0.70) -> DataFrame:
    """Pairs labelled 1 from ``positive`` on and 0 up to ``negative``; those between are not pairs."""
    return tiles(packed(a), packed(b), threshold_kernel(positive, negative), LABELLED, digits=9)


def pair_similarity(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Similarity of given pairs ``(i, j)``; pairs of which a side does not exist are left out."""
    left = a.select(F.col("idx").alias("i"), F.col("task").alias("task_i"), F.col("v").alias("v_i"))
    right = b.select(F.col("idx").alias("j"), F.col("task").alias("task_j"), F.col("v").alias("v_j"))
    return pairs.join(left, "i").join(right, "j").withColumn("sim", F.round(dot(F.col("v_i"), F.col("v_j")), 9)).drop("v_i", "v_j")


def metadata_match(queries: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """For each query ``qid`` the smallest ``idx`` whose keys agree wherever both sides have one; one key at least must be shared.

    Different combinations of keys are matched, each metadata combination with its smallest ``idx``, so
    that work grows with the combinations and not with rows times queries. One pass for each key
    equi-joins the combinations that have it.
    """
    own = [f"q_{k}" for k in keys]
    asked = queries.select("qid", *(F.col(k).alias(q) for k, q in zip(keys, own)))
    q, m = asked.select(*own).distinct(), metadata.groupBy(*keys).agg(F.min("idx").alias("idx"))
    agrees = " AND ".join(f"({q} IS NULL OR `{k}` IS NULL OR {q} = `{k}`)" for k, q in zip(keys, own))
    hits = None
    for k, name in zip(keys, own):
        one = q.join(m, F.col(name) == F.col(k)).where(agrees).select(*own, "idx")
        hits = one if hits is None else hits.unionByName(one)
    best = hits.groupBy(*own).agg(F.min("idx").alias("idx"))
    same = [asked[c].eqNullSafe(best[c]) for c in own]
    return asked.join(best, same).select("qid", "idx")


def write_cross(ego: DataFrame, tele: DataFrame, path: str, most: int = 500_000_000) -> bool:
    """Write all similarities ``(i, j, sim)`` as Parquet if there are fewer than ``most``; tells whether it did."""
    if ego.count() * tele.count() >= most:
        return False
    cross_matrix(ego, tele).write.mode("overwrite").parquet(path)
    return True


def cross_matrix(ego: DataFrame, tele: DataFrame) -> DataFrame:
    """All similarities, one row for each pair: as many rows as ego times tele."""

    def kernel(x, y, sims, own):
        i, j = (c.ravel() for c in np.meshgrid(x[0], y[0], indexing="ij"))
        return pd.DataFrame({"i": i, "j": j, "sim": sims.ravel()})

    return tiles(packed(ego), packed(tele), kernel, "i long, j long, sim double", digits=9)
