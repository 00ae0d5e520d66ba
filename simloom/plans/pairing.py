"""Queries on pairings, clusters and batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from simloom.functions.vector import dot
from simloom.operators import pairing as op
from simloom.operators.quantiles import quantile_columns
from simloom.operators.segments import numbered
from simloom.operators.similarity import cluster_stats as cluster_stats_of
from simloom.sources.scratch import stored
from simloom.sources.tables import vectors

from .base import CROSS, EGO_TELE, Registry
from .similarity import NEGATIVE, POSITIVE

query = Registry()
QUERIES, SQL = query.queries, query.sql

CHUNK, SAMPLE, K = 512, 500, 8
_SAMPLED = f"""{EGO_TELE}, q AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos FROM tele), ch AS (SELECT DISTINCT pos // {CHUNK} AS chunk FROM q),
ep AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos FROM ego), m AS (SELECT count(*) AS n FROM ego),
pr AS (SELECT n, min(x) AS p FROM m, unnest(range(greatest(n, 2), greatest(n, 2) + 400)) AS u(x) WHERE len(list_filter(range(2, floor(sqrt(x))::BIGINT + 1), lambda d: x % d = 0)) = 0 GROUP BY n),
h AS (SELECT chunk, n, p, ('0x' || substr(md5('42|a|' || chunk), 1, 12))::BIGINT % p AS a, ('0x' || substr(md5('42|b|' || chunk), 1, 12))::BIGINT % (p - 1) + 1 AS b FROM ch, pr),
j AS (SELECT chunk, n, j, (a + j * b) % p AS x FROM h, unnest(range(0, least({SAMPLE}, n) + p - n)) AS u(j)),
c AS (SELECT chunk, idx AS cand_idx, row_number() OVER (PARTITION BY chunk ORDER BY j) AS cand_pos FROM j JOIN ep ON ep.pos = j.x),
s AS (SELECT q.idx AS tele_idx, q.task AS tele_task, c.cand_idx, ego.task AS ego_task, cand_pos, round(list_dot_product(q.v, ego.v), 9) AS sim FROM q JOIN c ON c.chunk = q.pos // {CHUNK} AND cand_pos <= {SAMPLE} JOIN ego ON ego.idx = c.cand_idx),
sp AS (SELECT tele_idx, tele_task, cand_idx AS ego_idx, ego_task, sim FROM (SELECT *, row_number() OVER (PARTITION BY tele_idx ORDER BY sim DESC, cand_pos) AS r FROM s) WHERE r = 1)"""


@query(f"WITH {_SAMPLED} SELECT * FROM sp")
def sampled_pairing(spark, d):
    ego, tele = vectors(spark, d, "ego"), vectors(spark, d, "tele")
    chunks = -(-tele.count() // CHUNK)
    return op.sampled_pairing(ego, numbered(tele), op.chunk_candidates(ego, chunks, SAMPLE), CHUNK)


@query(f"WITH {_SAMPLED} SELECT count(*) AS n, round(avg(sim), 6) AS mean, round(min(sim), 6) AS least, round(median(sim), 6) AS median, round(max(sim), 6) AS largest FROM sp")
def pairing_stats(spark, d):
    rows = stored(sampled_pairing(spark, d), "pairing")
    (median,) = quantile_columns(rows, "sim", [0.5])
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.min("sim"), 6).alias("least"), F.round(median, 6).alias("median"), F.round(F.max("sim"), 6).alias("largest"))


_CENTERS = f"{EGO_TELE}, ce AS (SELECT idx // 2 AS cluster, v AS center FROM e WHERE idx < {2 * K} AND idx % 2 = 0), n AS (SELECT e.idx, e.task, ce.cluster, row_number() OVER (PARTITION BY e.idx ORDER BY round(list_dot_product(v, v) - 2 * list_dot_product(v, center) + list_dot_product(center, center), 9), cluster) AS r FROM e, ce), cl AS (SELECT idx, task, cluster::INT AS cluster FROM n WHERE r = 1)"


def _clusters(spark, d):
    rows = vectors(spark, d)
    centers = rows.where((F.col("idx") < 2 * K) & (F.col("idx") % 2 == 0)).select(F.expr("idx DIV 2").cast("int").alias("cluster"), F.col("v").alias("center"))
    return op.assign_clusters(rows.select("idx", "task", "v"), centers)


@query(f"WITH {_CENTERS} SELECT * FROM cl")
def kmeans_assign(spark, d):
    return _clusters(spark, d)


@query()
def kmeans_fit(spark, d):
    rows = vectors(spark, d)
    return op.assign_clusters(rows.select("idx", "task", "v"), op.fit_clusters(rows, K, 20))


@query()
def kmeans_minibatch(spark, d):
    """Rows with their cluster by mini-batch k-means; held against the same batches in NumPy in the tests."""
    rows = vectors(spark, d)
    return op.assign_clusters(rows.select("idx", "task", "v"), op.fit_minibatch(rows.select("idx", "v"), K, 20, starts=3))


@query(f"WITH {_CENTERS}, s AS (SELECT cluster, count(*) AS n FROM cl GROUP BY cluster) SELECT count(*) AS n_clusters, round(avg(n), 6) AS mean, min(n) AS least, max(n) AS largest FROM s")
def cluster_stats(spark, d):
    return _clusters(spark, d).groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_clusters"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("largest"))


@query(f"WITH {_CENTERS} SELECT a.cluster, count(*) AS n_pairs, round(max(list_dot_product(x.v, y.v)), 6) AS max_sim, round(avg(list_dot_product(x.v, y.v)), 6) AS mean_sim FROM cl a JOIN cl b ON a.cluster = b.cluster AND a.idx % 2 = 0 AND b.idx % 2 = 1 JOIN e x ON x.idx = a.idx JOIN e y ON y.idx = b.idx GROUP BY 1")
def cluster_cross(spark, d):
    own = _clusters(spark, d).select("idx", "cluster")
    return cluster_stats_of(vectors(spark, d, "ego").join(own, "idx"), vectors(spark, d, "tele").join(own, "idx")).select("cluster", "n_pairs", "max_sim", "mean_sim")


@query()
def hungarian_batches(spark, d):
    own = _clusters(spark, d).select("idx", "cluster")
    return op.merged_batches(vectors(spark, d, "ego").join(own, "idx"), vectors(spark, d, "tele").join(own, "idx"), 8)


@query()
def leftover_batches(spark, d):
    """The batches of what the clusters' own batches leave over."""
    return hungarian_batches(spark, d).where("cluster IS NULL").drop("cluster")


#: Given batches, so that what follows from batches can be told in SQL: 16 ego rows with the tele rows next to them.
_BATCHES = f"{EGO_TELE}, b AS (SELECT (idx // 32)::INT AS batch_id, ((idx // 2) % 16)::INT AS slot, idx AS ego_idx, idx + 1 AS tele_idx FROM ego QUALIFY count(*) OVER (PARTITION BY idx // 32) = 16), m AS (SELECT x.batch_id, x.slot AS i, y.slot AS j, round(list_dot_product(a.v, c.v), 9) AS sim, a.task AS ti, c.task AS tj FROM b x JOIN b y USING (batch_id) JOIN ego a ON a.idx = x.ego_idx JOIN tele c ON c.idx = y.tele_idx)"


def _batches(spark, d):
    """Batches of 16; an incomplete one is left over."""
    ego = vectors(spark, d, "ego").select("idx", F.count("*").over(Window.partitionBy(F.expr("idx DIV 32"))).alias("n")).where("n = 16")
    return ego.select(F.expr("idx DIV 32").cast("int").alias("batch_id"), F.expr("(idx DIV 2) % 16").cast("int").alias("slot"), F.col("idx").alias("ego_idx"), (F.col("idx") + 1).alias("tele_idx"))


def _matrix(spark, d):
    return op.batch_matrix(_batches(spark, d), vectors(spark, d, "ego"), vectors(spark, d, "tele"))


@query(f"WITH {_BATCHES} SELECT batch_id, i, j, sim FROM m")
def batch_matrix(spark, d):
    return _matrix(spark, d)


@query(f"WITH {_BATCHES} SELECT batch_id, count(*) AS n, round(avg(sim), 6) AS diag_mean, round(min(sim), 6) AS diag_min, round(max(sim), 6) AS diag_max FROM m WHERE i = j GROUP BY 1")
def batch_stats(spark, d):
    return _matrix(spark, d).where("i = j").groupBy("batch_id").agg(F.count("*").alias("n"), F.round(F.avg("sim"), 6).alias("diag_mean"), F.round(F.min("sim"), 6).alias("diag_min"), F.round(F.max("sim"), 6).alias("diag_max"))


@query(f"WITH {_BATCHES}, s AS (SELECT batch_id, count(*) AS n, avg(sim) AS a, min(sim) AS lo FROM m WHERE i = j GROUP BY 1), u AS (SELECT count(*) AS all_rows FROM ego) SELECT count(*) AS n_batches, sum(n)::BIGINT AS used, round(100.0 * sum(n) / max(all_rows), 6) AS utilisation, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(avg(lo), 6) AS mean_min, list_transform(quantile_cont(a, [0.1, 0.25, 0.5, 0.75, 0.9]), lambda x: round(x, 6)) AS percentiles FROM s, u")
def batch_summary(spark, d):
    per = _matrix(spark, d).where("i = j").groupBy("batch_id").agg(F.count("*").alias("n"), F.avg("sim").alias("a"), F.min("sim").alias("lo"))
    n = vectors(spark, d, "ego").count()
    per = stored(per, "batches")
    cuts = quantile_columns(per, "a", [0.1, 0.25, 0.5, 0.75, 0.9])
    return per.agg(F.count("*").alias("n_batches"), F.sum("n").alias("used"), F.round(100.0 * F.sum("n") / n, 6).alias("utilisation"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.stddev_pop("a"), 6).alias("std"), F.round(F.avg("lo"), 6).alias("mean_min"), F.array(*(F.round(x, 6) for x in cuts)).alias("percentiles"))


@query(f"WITH {_BATCHES} SELECT b.batch_id, b.slot, b.ego_idx, b.tele_idx, a.task AS ego_task, c.task AS tele_task, m.sim FROM b JOIN ego a ON a.idx = b.ego_idx JOIN tele c ON c.idx = b.tele_idx JOIN m ON m.batch_id = b.batch_id AND m.i = b.slot AND m.j = b.slot")
def batch_detail(spark, d):
    ego = vectors(spark, d, "ego").select(F.col("idx").alias("ego_idx"), F.col("task").alias("ego_task"))
    tele = vectors(spark, d, "tele").select(F.col("idx").alias("tele_idx"), F.col("task").alias("tele_task"))
    diagonal = _matrix(spark, d).where("i = j").select("batch_id", F.col("i").alias("slot"), "sim")
    return _batches(spark, d).join(ego, "ego_idx").join(tele, "tele_idx").join(diagonal, ["batch_id", "slot"])


@query(f"WITH {_BATCHES} SELECT batch_id, count(*) FILTER (i = j) AS n_pairs, count(*) FILTER (i = j AND ti = tj) AS n_same, count(*) FILTER (i = j AND ti <> tj) AS n_diff, round(avg(sim), 6) AS mean_all FROM m GROUP BY 1")
def batch_report(spark, d):
    same = batch_detail(spark, d).groupBy("batch_id").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("ego_task") == F.col("tele_task")).alias("n_same"), F.count_if(F.col("ego_task") != F.col("tele_task")).alias("n_diff"))
    return same.join(_matrix(spark, d).groupBy("batch_id").agg(F.round(F.avg("sim"), 6).alias("mean_all")), "batch_id")


@query(f"WITH {_BATCHES}, dg AS (SELECT * FROM m WHERE i = j) SELECT batch_id, (list(i ORDER BY sim DESC, i))[1] AS best, (list(i ORDER BY sim, i))[1] AS worst FROM dg GROUP BY 1")
def batch_best_worst(spark, d):
    diagonal = _matrix(spark, d).where("i = j")
    return diagonal.groupBy("batch_id").agg(F.max(F.struct("sim", (-F.col("i")).alias("n"), "i")).alias("hi"), F.min(F.struct("sim", "i")).alias("lo")).select("batch_id", F.col("hi.i").alias("best"), F.col("lo.i").alias("worst"))


@query(f"WITH {_BATCHES} SELECT idx, task FROM ego WHERE idx NOT IN (SELECT ego_idx FROM b)")
def leftovers(spark, d):
    return op.leftovers(vectors(spark, d, "ego").select("idx", "task"), _batches(spark, d), "ego")


@query(f"WITH {CROSS}, p AS (SELECT i, j, s AS sim, (s >= {POSITIVE})::INT AS label FROM x WHERE s >= {POSITIVE} OR s <= {NEGATIVE}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || i || '|' || j), i, j) AS nth FROM p) SELECT i, j, sim, label, nth::INT AS nth FROM r WHERE nth <= CASE WHEN label = 1 THEN 30 ELSE 60 END")
def test_set(spark, d):
    return op.labelled_sets_of(vectors(spark, d, "ego"), vectors(spark, d, "tele"), POSITIVE, NEGATIVE, 30, 60)


@query(f"WITH {EGO_TELE}, z AS (SELECT idx, idx // 64 AS batch, CASE WHEN idx % 9 = 0 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE v END AS v FROM e) SELECT a.batch, a.idx AS i, b.idx AS j, round(list_dot_product(a.v, b.v), 9) AS sim, (round(list_dot_product(a.v, b.v), 9) >= {POSITIVE})::INT AS label FROM z a JOIN z b USING (batch) WHERE a.idx % 2 = 0 AND b.idx % 2 = 1")
def matched_batch(spark, d):
    """Batches of 32 ego and 32 tele rows; rows whose task is not known have a vector of zeros."""
    known = F.when(F.col("idx") % 9 != 0, F.col("v"))
    rows = vectors(spark, d).select(F.expr("idx DIV 64").alias("batch"), "idx", F.coalesce(known, F.transform("v", lambda x: F.lit(0.0))).alias("v"))
    ego = rows.where("idx % 2 = 0").select("batch", F.col("idx").alias("i"), F.col("v").alias("v_ego"))
    tele = rows.where("idx % 2 = 1").select("batch", F.col("idx").alias("j"), F.col("v").alias("v_tele"))
    sims = ego.join(tele, "batch").select("batch", "i", "j", F.round(dot(F.col("v_ego"), F.col("v_tele")), 9).alias("sim"))
    return sims.withColumn("label", (F.col("sim") >= POSITIVE).cast("int"))
