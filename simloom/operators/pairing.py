"""Pairing of two collections: sampled best matches, clusters, one-to-one batches."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.hashes import pair_hashes
from simloom.functions.series import assigned
from simloom.functions.vector import dot
from simloom.operators import assignment
from simloom.operators.auction import auction
from simloom.operators.clustering import fit_minibatch
from simloom.operators.pruned import threshold_pairs, threshold_tiles
from simloom.operators.segments import numbered, seeded
from simloom.operators.similarity import LABELLED, labelled
from simloom.sources.scratch import discard, stored

CHUNK = 512
#: Most rows of a cluster's smaller side that are assigned in one task: exact, and far sooner than the many jobs of an auction.
MOST_ROWS = 131_072
#: Clusters of which several in one task would take long, by the rows of their smaller side.
LONG_ROWS = 4096


def next_prime(n: int) -> int:
    """The smallest prime of ``n`` or more."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def chunk_candidates(ego: DataFrame, chunks: int, n_sample: int, seed: int = 42) -> DataFrame:
    """``(chunk, cand_pos, cand_idx)``: for each chunk ``n_sample`` ego rows by seeded draws, without replacement.

    A chunk draws the places ``(a + j b) mod p``, with seeded ``a`` and ``b`` and the smallest prime ``p``
    that is not below the number of ego rows; none comes twice. So the work grows with the number of
    candidates, not with ego rows times chunks.
    """
    n = ego.count()
    p, most = next_prime(n), min(n_sample, n)
    a, b = seeded(seed, F.lit("a"), F.col("chunk")) % p, seeded(seed, F.lit("b"), F.col("chunk")) % (p - 1) + 1
    steps = F.sequence(F.lit(0).cast("long"), F.lit(most + p - n - 1).cast("long"))
    chosen = ego.sparkSession.range(chunks).select(F.col("id").cast("int").alias("chunk")).select("chunk", a.alias("a"), b.alias("b"))
    places = F.slice(F.filter(F.transform(steps, lambda j: (F.col("a") + j * F.col("b")) % p), lambda x: x < n), 1, most) if most else F.array().cast("array<bigint>")
    chosen = chosen.select("chunk", F.posexplode(places).alias("nth", "ego_pos"))
    return chosen.join(numbered(ego.select("idx"), "idx", "ego_pos"), "ego_pos").select("chunk", (F.col("nth") + 1).alias("cand_pos"), F.col("idx").alias("cand_idx"))


def sampled_pairing(ego: DataFrame, tele: DataFrame, candidates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """For each tele row the most similar of its chunk's candidates; of ties the first one drawn. Ego rows may serve again.

    A chunk's rows and candidates meet in one task, as one matrix product.
    """
    queries = tele.select(F.col("idx").alias("tele_idx"), F.col("task").alias("tele_task"), "v", F.floor(F.col("pos") / chunk).cast("int").alias("chunk"))
    offered = candidates.join(ego.select(F.col("idx").alias("cand_idx"), F.col("task").alias("ego_task"), "v"), "cand_idx")

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame([], columns=["tele_idx", "tele_task", "ego_idx", "ego_task", "sim"])
        c = c.sort_values("cand_pos")
        sims = np.round(np.stack(q["v"].to_numpy()) @ np.stack(c["v"].to_numpy()).T, 9)
        at = sims.argmax(axis=1)
        return pd.DataFrame({"tele_idx": q["tele_idx"].to_numpy(), "tele_task": q["tele_task"].to_numpy(), "ego_idx": c["cand_idx"].to_numpy()[at], "ego_task": c["ego_task"].to_numpy()[at], "sim": sims[np.arange(len(at)), at]})

    return queries.groupBy("chunk").cogroup(offered.groupBy("chunk")).applyInPandas(best, "tele_idx long, tele_task long, ego_idx long, ego_task long, sim double")


def fit_clusters(vectors: DataFrame, k: int, iterations: int = 100, seed: int = 42, starts: int = 3):
    """k-means over all rows, the best of several starts by cost; gives ``(cluster, center)``."""
    rows = vectors.select(array_to_vector("v").alias("features"))
    fits = (KMeans(k=k, maxIter=iterations, seed=seed + s, featuresCol="features").fit(rows) for s in range(starts))
    model = min(fits, key=lambda m: m.summary.trainingCost)
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")


def assign_clusters(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """The nearest center of each row (squared distance to 9 decimals; ties to the lower number), with a broadcast of the k centers."""
    table = sorted((r["cluster"], r["center"]) for r in centers.collect())
    numbers = np.array([c for c, _ in table])
    matrix = np.array([x for _, x in table])

    def nearest(batches):
        for rows in batches:
            v = np.stack(rows["v"].to_numpy())
            far = np.round(((v**2).sum(1)[:, None] - 2 * v @ matrix.T + (matrix**2).sum(1)), 9)
            yield rows.drop(columns="v").assign(cluster=numbers[far.argmin(axis=1)])

    kept = [f for f in vectors.schema.fields if f.name != "v"]
    return vectors.mapInPandas(nearest, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "cluster int"]))


def collapsed(clusters: DataFrame, k: int) -> bool:
    """Whether too few clusters hold rows, so that another clustering should be tried (k of ten or more)."""
    return k >= 10 and clusters.select("cluster").distinct().count() < max(10, k // 10)


def cluster(vectors: DataFrame, k: int, iterations: int = 100, seed: int = 42, most_dims: int = 256) -> DataFrame:
    """Rows with their ``cluster``: k-means; where that fails or has collapsed, mini-batch k-means on at most ``most_dims`` principal components."""
    try:
        found = assign_clusters(vectors, fit_clusters(vectors, k, iterations, seed))
        if not collapsed(found, k):
            return found
    except Exception as failed:  # whatever it is, there is another way
        warnings.warn(f"k-means failed, mini-batches are tried: {failed}", stacklevel=2)
    return fallback_clusters(vectors, k, iterations, seed, most_dims)


def fallback_clusters(vectors: DataFrame, k: int, steps: int = 100, seed: int = 42, most_dims: int = 256) -> DataFrame:
    """Rows with their ``cluster`` by mini-batch k-means on at most ``most_dims`` principal components."""
    first = vectors.select(F.size("v").alias("n")).first()
    rows = vectors
    if first and first["n"] > most_dims:
        rows = vectors.withColumn("features", array_to_vector("v"))
        rows = PCA(k=most_dims, inputCol="features", outputCol="reduced").fit(rows).transform(rows).withColumn("v", vector_to_array("reduced")).drop("features", "reduced")
    return assign_clusters(rows, fit_minibatch(rows.select("idx", "v"), k, steps, seed=seed))


def best_pairs(e: np.ndarray, t: np.ndarray, most_bytes: int = 1 << 28) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and similarities of an assignment of largest total similarity, the best pair first.

    Similarities of a row are computed when they are first needed and kept up to ``most_bytes``, beyond that computed again. More rows
    than ``assignment.FROM_ROWS`` know their most similar ones only.
    """
    few, many = (e, t) if len(e) <= len(t) else (t, e)
    kept: dict[int, np.ndarray] = {}

    def cost_of(i):
        if i in kept:
            return kept[i]
        cost = -(many @ few[i])
        if (len(kept) + 1) * cost.nbytes <= most_bytes:
            kept[i] = cost
        return cost

    own = np.arange(len(few))
    listed = len(few) > assignment.FROM_ROWS and np.isfinite(few).all() and np.isfinite(many).all()
    other = assignment.assigned(few, many) if listed else assigned(cost_of, len(few), len(many))
    i, j = (own, other) if few is e else (other, own)
    value = np.einsum("ij,ij->i", e[i], t[j])
    order = np.lexsort((i, -np.round(value, 9)))
    return i[order], j[order], value[order]


def one_to_one_batches(ego: DataFrame, tele: DataFrame, batch: int, most_rows: int = MOST_ROWS, eps: float = 1e-6) -> DataFrame:
    """One-to-one batches in each cluster: ``(cluster, batch_no, slot, ego_idx, tele_idx, sim)``.

    Repeated ``min(E // batch, T // batch)`` times: an assignment of largest total similarity over
    what is left, of which the ``batch`` best pairs make a batch. What is left of a best assignment
    without some of its pairs is a best assignment of the other rows, so that one for each cluster
    serves all its batches. A cluster whose smaller side has up to ``most_rows`` is assigned exactly in one task, which long ones share with few others; a larger
    one by ``auction``, whose total is at most ``eps`` for each row of that side below the best.
    """
    ego, tele = (x.select(F.col("cluster").cast("int").alias("cluster"), "idx", "v") for x in (ego, tele))
    sizes = ego.groupBy("cluster").count().withColumnRenamed("count", "e").join(tele.groupBy("cluster").agg(F.count("*").alias("t")), "cluster")
    long = sizes.where(F.least("e", "t") > min(most_rows, LONG_ROWS)).collect()
    large = [(r["cluster"], r["e"] <= r["t"]) for r in long if min(r["e"], r["t"]) > most_rows]
    parts = min(1000, 8 * (len(long) - len(large)) ** 2)
    if not large:
        return _small_batches(ego, tele, batch, parts)
    names = [c for c, _ in large]
    out = _small_batches(ego.where(~F.col("cluster").isin(names)), tele.where(~F.col("cluster").isin(names)), batch, parts)
    for ego_bids in (True, False):
        some = F.col("cluster").isin([c for c, few in large if few == ego_bids])
        bidders, rows = (ego, tele) if ego_bids else (tele, ego)
        pairs = auction(bidders.where(some), rows.where(some), eps).select("cluster", *(F.col(c).alias(n) for c, n in (("bidder", "ego_idx"), ("row", "tele_idx")) if ego_bids), *(F.col(c).alias(n) for c, n in (("row", "ego_idx"), ("bidder", "tele_idx")) if not ego_bids), F.col("value").alias("sim"))
        out = out.unionByName(_in_batches(pairs.join(F.broadcast(sizes), "cluster"), batch))
    return out


def _in_batches(pairs: DataFrame, batch: int) -> DataFrame:
    """Pairs ``(cluster, ego_idx, tele_idx, sim, e, t)`` of an assignment, the best first, in full batches."""
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("sim", 9)), "ego_idx")
    nth = pairs.withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < F.least(F.expr(f"e DIV {batch}"), F.expr(f"t DIV {batch}")) * batch)
    return nth.select("cluster", F.expr(f"nth DIV {batch}").cast("int").alias("batch_no"), (F.col("nth") % batch).cast("int").alias("slot"), "ego_idx", "tele_idx", "sim")


def _small_batches(ego: DataFrame, tele: DataFrame, batch: int, parts: int = 0) -> DataFrame:
    """The same for clusters of which each is assigned in one task; dealt to ``parts`` partitions, if given, so that hardly two long ones meet."""

    def solve(key, e: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        e, t = e.sort_values("idx"), t.sort_values("idx")
        used = min(len(e) // batch, len(t) // batch) * batch
        if not used:
            return pd.DataFrame([], columns=columns)
        i, j, sim = (x[:used] for x in best_pairs(np.stack(e["v"].to_numpy()), np.stack(t["v"].to_numpy())))
        number, slot = np.divmod(np.arange(used), batch)
        return pd.DataFrame({"cluster": key[0], "batch_no": number, "slot": slot, "ego_idx": e["idx"].to_numpy()[i], "tele_idx": t["idx"].to_numpy()[j], "sim": sim})

    columns = ["cluster", "batch_no", "slot", "ego_idx", "tele_idx", "sim"]
    ego, tele = (x.toDF("cluster", "idx", "v") for x in (ego, tele))
    if parts > 8:
        ego, tele = (x.repartition(parts, "cluster") for x in (ego, tele))
    return ego.groupBy("cluster").cogroup(tele.groupBy("cluster")).applyInPandas(solve, "cluster int, batch_no int, slot int, ego_idx long, tele_idx long, sim double")


def merged_batches(ego: DataFrame, tele: DataFrame, batch: int) -> DataFrame:
    """``one_to_one_batches``, then those of one more assignment over all rows that no cluster's batch uses; their cluster is null."""
    own = stored(one_to_one_batches(ego, tele, batch), "cluster-batches")
    rest = (leftovers(x.select("idx", "v"), own, side).select(F.lit(0).alias("cluster"), "idx", "v") for x, side in ((ego, "ego"), (tele, "tele")))
    return own.unionByName(one_to_one_batches(*rest, batch).withColumn("cluster", F.lit(None).cast("int")))


def leftovers(rows: DataFrame, batches: DataFrame, side: str) -> DataFrame:
    """Rows of a side that no batch uses."""
    return rows.join(batches.select(F.col(f"{side}_idx").alias("idx")), "idx", "left_anti")


def batch_matrix(batches: DataFrame, ego: DataFrame, tele: DataFrame) -> DataFrame:
    """All similarities within each batch ``(batch_id, slot, ego_idx, tele_idx)``: ``(batch_id, i, j, sim)``."""
    left = batches.select("batch_id", F.col("slot").alias("i"), F.col("ego_idx").alias("idx")).join(ego.select("idx", F.col("v").alias("a")), "idx").drop("idx")
    right = batches.select("batch_id", F.col("slot").alias("j"), F.col("tele_idx").alias("idx")).join(tele.select("idx", F.col("v").alias("b")), "idx").drop("idx")
    return left.join(right, "batch_id").select("batch_id", "i", "j", F.round(dot(F.col("a"), F.col("b")), 9).alias("sim"))


def _pair_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string")))


def labelled_sets(pairs: DataFrame, n_pos: int, n_neg: int, seed: int = 7) -> DataFrame:
    """``n_pos`` pairs of label 1 and ``n_neg`` of label 0, by least seeded hash, numbered by ``nth`` within their label.

    The first of each label are found partition by partition; only they are numbered in one place.
    """
    order = [_pair_key(seed), "i", "j"]
    chosen = [pairs.where(F.col("label") == label).orderBy(*order).limit(n) for label, n in ((1, n_pos), (0, n_neg))]
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    return chosen[0].unionByName(chosen[1]).withColumn("nth", rank)


def balanced_pairs(pairs: DataFrame, ratio: float = 1.0, seed: int = 7) -> DataFrame:
    """All pairs of label 1, and of label 0 ``ratio`` times as many (rounded down), by least seeded hash.

    Pairs are stored once. A hash that about as many have as are wanted, and the count up to it, are found first; only pairs between that
    and a hash which too many have are put in order, so that no task gets all of them.
    """
    pairs = stored(pairs, "labelled-pairs")
    negative = pairs.where("label = 0").withColumn("hash", seeded_pair(seed))
    sizes = {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()}
    wanted, there = int(sizes.get(1, 0) * ratio), sizes.get(0, 0)
    if wanted < there:
        part, spare = wanted / there, 5 * math.sqrt(wanted + 1) / there + 0.001
        sure, most = (int(max(0.0, min(1.0, x)) * (1 << 48)) for x in (part - spare, part + spare))
        within = F.col("hash") < sure
        rest = wanted - negative.where(within).count()
        open_ = negative.where(~within)
        if rest >= 0 and open_.where(F.col("hash") < most).count() >= rest:
            open_ = open_.where(F.col("hash") < most)
            chosen = negative.where(within)
        else:  # hashes lie otherwise than they should
            open_, chosen, rest = negative, negative.limit(0), wanted
        negative = chosen.unionByName(open_.orderBy(_pair_key(seed), "i", "j").limit(rest))
    return pairs.where("label = 1").unionByName(negative.drop("hash"))


def labelled_sets_of(a: DataFrame, b: DataFrame, positive: float, negative: float, n_pos: int, n_neg: int, seed: int = 7) -> DataFrame:
    """``labelled_sets`` of the pairs of ``threshold_pairs``: hashed in their tile, which gives only the first of each label."""

    def kernel(x, y, sims, own):
        i, j, s = labelled(sims, positive, negative)
        label = (s >= positive).astype(np.int32)
        hashes = pair_hashes(seed, x[0], y[0], i, j)
        kept = []
        for value, n in ((1, n_pos), (0, n_neg)):
            part = np.flatnonzero(label == value)
            if len(part) > n > 0:
                part = part[hashes[part] <= np.partition(hashes[part], n - 1)[n - 1]]
            kept.append(part[: None if n else 0])
        kept = np.concatenate(kept)
        return pd.DataFrame({"i": x[0][i[kept]], "j": y[0][j[kept]], "sim": s[kept], "label": label[kept]})

    return labelled_sets(stored(threshold_tiles(a, b, positive, negative, kernel, LABELLED), "first-pairs"), n_pos, n_neg, seed)


def balanced_pairs_of(a: DataFrame, b: DataFrame, positive: float, negative: float, ratio: float = 1.0, seed: int = 7) -> DataFrame:
    """``balanced_pairs`` of the pairs of ``threshold_pairs``.

    Labels are counted first. Then a tile gives only pairs of label 0 whose hash is below one that more have than are wanted, and these are
    stored with 32 bits of it. Ranges of hashes are counted; only the range in which the wanted number ends is put in order.
    """

    def count(x, y, sims, own):
        s = labelled(sims, positive, negative)[2]
        ones = int((s >= positive).sum())
        return pd.DataFrame({"ones": [ones], "zeros": [len(s) - ones]})

    sizes = threshold_tiles(a, b, positive, negative, count, "ones long, zeros long").agg(F.coalesce(F.sum("ones"), F.lit(0)).alias("ones"), F.coalesce(F.sum("zeros"), F.lit(0)).alias("zeros")).first()
    wanted, there = int(sizes["ones"] * ratio), sizes["zeros"]
    if wanted >= there:
        return threshold_pairs(a, b, positive, negative)

    def below(most: int) -> Callable:
        def kernel(x, y, sims, own):
            i, j, s = labelled(sims, positive, negative)
            label = (s >= positive).astype(np.int32)
            hashes = np.full(len(s), -1)
            zeros = np.flatnonzero(label == 0)
            hashes[zeros] = pair_hashes(seed, x[0], y[0], i[zeros], j[zeros])
            kept = hashes < most
            i, j = i[kept], j[kept]
            return pd.DataFrame({"i": x[0][i], "j": y[0][j], "sim": s[kept], "label": label[kept], "hash": hashes[kept]})

        return kernel

    share = wanted / there + 5 * math.sqrt(wanted + 1) / there + 0.001
    for most in (min(1 << 32, int(share * (1 << 32))), 1 << 32):
        pairs = stored(threshold_tiles(a, b, positive, negative, below(most), f"{LABELLED}, hash long"), "balanced-pairs")
        ranges = pairs.where("label = 0").groupBy(F.shiftright("hash", 16).alias("range")).count().orderBy("range").collect()  # 65,536 at most
        if sum(r["count"] for r in ranges) >= wanted:
            break
        discard(pairs)  # hashes lie otherwise than they should
    last, rest = 0, wanted
    for r in ranges:
        last = r["range"]
        if rest <= r["count"]:
            break
        rest -= r["count"]
    number = F.shiftright("hash", 16)
    open_ = pairs.where((F.col("label") == 0) & (number == last)).orderBy(_pair_key(seed), "i", "j").limit(rest)
    return pairs.where((F.col("label") == 1) | (number < last)).unionByName(open_).drop("hash")


def seeded_pair(seed: int) -> Column:
    """The first 48 bits of a pair's seeded hash, in the same order."""
    return F.conv(F.substring(_pair_key(seed), 1, 12), 16, 10).cast("long")


def matched_batch(task_pairs: DataFrame, ego: DataFrame, tele: DataFrame, size: int = 16, seed: int = 42, in_turn: bool = False) -> DataFrame:
    """A batch of ``size // 2`` rows a side out of matching tasks: ``(slot, side, idx, task)``.

    ``task_pairs``: ``(ego_task, tele_task)``, different ones; those of which both tasks have rows can be drawn. Each slot draws a pair
    with replacement, or ``in_turn`` takes the next one in a seeded order, so that none is left out while there are slots; and of each of its tasks
    the row with the least seeded hash. Without a pair to draw: an error.
    """
    half, spark = size // 2, ego.sparkSession
    there = task_pairs.join(ego.select(F.col("task").alias("ego_task")), "ego_task", "left_semi").join(tele.select(F.col("task").alias("tele_task")), "tele_task", "left_semi")
    there = stored(there.select("ego_task", "tele_task"), "task-pairs")
    n = there.count()
    if not n:
        raise ValueError("no pair of matching tasks of which both have rows")
    at = F.col("id") % min(n, half) if in_turn else seeded(seed, F.lit("pair"), F.col("id")) % n
    order = (seeded(seed, F.col("ego_task"), F.col("tele_task")), "at", "ego_task", "tele_task") if in_turn else ("ego_task", "at", "tele_task")
    drawn = spark.range(half).select(F.col("id").cast("int").alias("slot"), at.alias("at"))
    pairs = F.broadcast(drawn).join(numbered(there, *order), "at")
    out = []
    for side, rows in (("ego", ego), ("tele", tele)):
        wanted = pairs.select("slot", F.col(f"{side}_task").alias("task"))
        offered = rows.select("idx", "task").join(F.broadcast(wanted), "task")  # ``half`` rows
        first = offered.groupBy("slot", "task").agg(F.min(F.struct(seeded(seed, F.col("slot"), F.col("idx")), "idx"))["idx"].alias("idx"))
        out.append(first.select("slot", F.lit(side).alias("side"), "idx", "task"))
    return out[0].unionByName(out[1])
