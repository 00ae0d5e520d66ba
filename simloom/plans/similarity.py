"""Queries on similarities of segments."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from simloom.functions.vector import dot, similarity
from simloom.operators import reports
from simloom.operators import pruned
from simloom.operators import similarity as op
from simloom.sources.scratch import stored
from simloom.sources.tables import table, vectors

from .base import CROSS, EGO_TELE, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql
_STATS = "round(max(s), 6) AS max_sim, round(min(s), 6) AS min_sim, round(avg(s), 6) AS mean_sim, round(stddev_pop(s), 6) AS std_sim"
POSITIVE, NEGATIVE = 0.30, -0.10


@query(f"WITH {CROSS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM x) SELECT i AS query_idx, ti AS query_task, j AS match_idx, tj AS match_task, s AS sim, rank::INT AS rank, ti = tj AS same_task FROM r WHERE rank <= 5")
def topk(spark, d):
    return pruned.topk(vectors(spark, d, "ego"), vectors(spark, d, "tele"), 5)


@query(f"WITH {CROSS} SELECT count(*) AS n_pairs, {_STATS} FROM x")
def cross_stats(spark, d):
    return op.cross_stats(vectors(spark, d, "ego"), vectors(spark, d, "tele"))


@query(f"WITH {CROSS} SELECT ti = tj AS same_task, count(*) AS n_pairs, {_STATS} FROM x GROUP BY 1")
def same_vs_diff_task(spark, d):
    return op.cross_stats(vectors(spark, d, "ego"), vectors(spark, d, "tele"), by_task=True)


@query(f"WITH {EGO_TELE}, x AS (SELECT list_dot_product(a.v, b.v) AS s FROM ego a, ego b WHERE a.idx < b.idx) SELECT count(*) AS n_pairs, {_STATS} FROM x")
def self_stats(spark, d):
    return op.self_stats(vectors(spark, d, "ego"))


@query(f"WITH {EGO_TELE} SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.v, b.v), 9) AS sim FROM ego a, ego b WHERE a.idx < b.idx AND a.grp <> b.grp ORDER BY sim DESC, i, j LIMIT 10")
def self_top_pairs(spark, d):
    ego = vectors(spark, d, "ego")
    return pruned.best_pairs(ego, ego, 10, within=True)


@query(f"WITH {CROSS} (SELECT i, j, s AS sim, 'top' AS part FROM x ORDER BY s DESC, i, j LIMIT 18) UNION ALL (SELECT i, j, s, 'bottom' FROM x ORDER BY s, i, j LIMIT 10)")
def top_bottom(spark, d):
    ego, tele = vectors(spark, d, "ego"), vectors(spark, d, "tele")
    return pruned.best_pairs(ego, tele, 18).withColumn("part", F.lit("top")).unionByName(pruned.best_pairs(ego, tele, 10, largest=False).withColumn("part", F.lit("bottom")))


@query(f"WITH {CROSS} SELECT i, j, s AS sim, (s >= {POSITIVE})::INT AS label FROM x WHERE s >= {POSITIVE} OR s <= {NEGATIVE}")
def threshold_pairs(spark, d):
    return pruned.threshold_pairs(vectors(spark, d, "ego"), vectors(spark, d, "tele"), POSITIVE, NEGATIVE)


def _positive_pairs(spark, d):
    """The pairs of label 1 only; the others don't leave their tiles."""
    return pruned.threshold_pairs(vectors(spark, d, "ego"), vectors(spark, d, "tele"), POSITIVE, -math.inf).drop("label")


@query(f"WITH {EGO_TELE}, q AS (SELECT v FROM e WHERE idx = 0) SELECT e.idx, e.task, round(list_dot_product(e.v, q.v), 9) AS sim FROM e, q ORDER BY sim DESC, e.idx DESC LIMIT 5")
def retriever_search(spark, d):
    rows = vectors(spark, d)
    return op.search(rows, list(rows.where("idx = 0").first()["v"]), 5)


@query(f"WITH {EGO_TELE}, p AS (SELECT idx AS i, ((idx * 31) % 600) * 2 + 1 AS j FROM ego) SELECT p.i, p.j, a.task AS task_i, b.task AS task_j, round(list_dot_product(a.v, b.v), 9) AS sim FROM p JOIN ego a ON a.idx = p.i JOIN tele b ON b.idx = p.j")
def pair_lookup(spark, d):
    ego = vectors(spark, d, "ego")
    return op.pair_similarity(ego.select(F.col("idx").alias("i"), ((F.col("idx") * 31) % 600 * 2 + 1).alias("j")), ego, vectors(spark, d, "tele"))


@query("WITH m AS (SELECT doc_id AS idx, lang AS k1, source AS k2, CASE WHEN doc_id % 3 > 0 THEN n_chars % 5 END AS k3 FROM documents), q AS (SELECT doc_id AS qid, CASE WHEN doc_id % 2 = 0 THEN lang END AS k1, CASE WHEN doc_id % 5 > 0 THEN source END AS k2, n_chars % 5 AS k3 FROM documents WHERE doc_id % 20 = 0) SELECT qid, min(idx) AS idx FROM q JOIN m ON (q.k1 IS NULL OR m.k1 IS NULL OR q.k1 = m.k1) AND (q.k2 IS NULL OR m.k2 IS NULL OR q.k2 = m.k2) AND (q.k3 IS NULL OR m.k3 IS NULL OR q.k3 = m.k3) AND (q.k1 = m.k1 OR q.k2 = m.k2 OR q.k3 = m.k3) GROUP BY qid")
def meta_match(spark, d):
    docs = table(spark, d, "documents")
    some = F.col("n_chars") % 5
    meta = docs.select(F.col("doc_id").alias("idx"), F.col("lang").alias("k1"), F.col("source").alias("k2"), F.when(F.col("doc_id") % 3 > 0, some).alias("k3"))
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("k1"), F.when(F.col("doc_id") % 5 > 0, F.col("source")).alias("k2"), some.alias("k3"))
    return op.metadata_match(asked, meta, ["k1", "k2", "k3"])


@query(f"WITH {CROSS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM x) SELECT rank::INT AS rank, count(*) AS n, round(avg((ti = tj)::INT), 6) AS same_task_rate FROM r WHERE rank <= 5 GROUP BY 1")
def same_task_rate(spark, d):
    return topk(spark, d).groupBy("rank").agg(F.count("*").alias("n"), F.round(F.avg(F.col("same_task").cast("int")), 6).alias("same_task_rate"))


@query(f"WITH {CROSS}, b AS (SELECT CASE WHEN s >= 0.4 THEN 'HIGH' WHEN s >= 0.3 THEN 'MID' WHEN s >= 0.2 THEN 'LOW' ELSE 'BAD' END AS band, CASE WHEN s > 0.35 THEN 'green' WHEN s > 0.25 THEN 'yellow' ELSE 'red' END AS colour FROM x WHERE s >= {POSITIVE} OR s <= {NEGATIVE}) SELECT band, colour, count(*) AS n FROM b GROUP BY ALL")
def sim_bands(spark, d):
    bands, colours = [("HIGH", 0.4), ("MID", 0.3), ("LOW", 0.2), ("BAD", None)], [("green", 0.35), ("yellow", 0.25), ("red", None)]
    return op.band_counts(vectors(spark, d, "ego"), vectors(spark, d, "tele"), bands, colours, POSITIVE, NEGATIVE)


@query(f"WITH {CROSS}, p AS (SELECT s AS sim FROM x WHERE s >= {POSITIVE} OR s <= {NEGATIVE}), m AS (SELECT min(sim) AS lo, max(sim) AS hi FROM p) SELECT least(floor((sim - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM p, m GROUP BY 1")
def sim_histogram(spark, d):
    return op.pair_histogram(vectors(spark, d, "ego"), vectors(spark, d, "tele"), 20, POSITIVE, NEGATIVE)


@query(f"WITH {CROSS}, m AS (SELECT min(s) AS lo, max(s) AS hi FROM x) SELECT least(floor((s - lo) / ((hi - lo) / 20)), 19)::INT AS bin, count(*) AS n FROM x, m GROUP BY 1")
def sim_histogram_all(spark, d):
    return op.pair_histogram(vectors(spark, d, "ego"), vectors(spark, d, "tele"), 20)


@query(f"WITH {CROSS}, p AS (SELECT i, j, s AS sim FROM x WHERE s >= {POSITIVE}), n AS (SELECT *, row_number() OVER (ORDER BY sim DESC, i, j) - 1 AS n FROM p) SELECT i, j, sim, (n // 12)::INT AS page, ((n % 12) // 4)::INT AS grid_row, (n % 4)::INT AS grid_col FROM n")
def paginate(spark, d):
    return reports.paged(stored(_positive_pairs(spark, d), "positive-pairs"), 12, 4, -F.col("sim"), "i", "j")


@query(f"WITH {CROSS}, p AS (SELECT i, j, s AS sim FROM x WHERE s >= {POSITIVE}) (SELECT i, j, sim, 'best' AS mode FROM p ORDER BY sim DESC, i, j LIMIT 9) UNION ALL (SELECT i, j, sim, 'first' FROM p ORDER BY i, j LIMIT 9)")
def viz_select(spark, d):
    ego, tele = vectors(spark, d, "ego"), vectors(spark, d, "tele")
    best = op.best_pairs(ego, tele, 9, least=POSITIVE).withColumn("mode", F.lit("best"))
    return best.unionByName(op.first_pairs(ego, tele, 9, POSITIVE).withColumn("mode", F.lit("first")))


@query(f"WITH {CROSS} SELECT i, j, s AS sim FROM x")
def cross_matrix(spark, d):
    return op.cross_matrix(vectors(spark, d, "ego"), vectors(spark, d, "tele"))


@query(f"WITH {CROSS} SELECT i, j, trunc(255 * (1 - s * 1.0::DOUBLE))::INT AS r, trunc(255 * (1 - s * 0.5::DOUBLE))::INT AS g, trunc(255 * (1 - s * 0.3::DOUBLE))::INT AS b FROM x WHERE s >= {POSITIVE}")
def heatmap_rgb(spark, d):
    return _positive_pairs(spark, d).select("i", "j", *reports.heat(F.col("sim")))


@query(f"WITH {EGO_TELE} SELECT DISTINCT task FROM ego WHERE task < 7 AND task IN (SELECT task FROM tele WHERE task > 3)")
def task_overlap(spark, d):
    return vectors(spark, d, "ego").where("task < 7").select("task").intersect(vectors(spark, d, "tele").where("task > 3").select("task"))


@query("SELECT DISTINCT lower(trim(substr(text, 1, 40))) AS task FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)")
def task_vocab(spark, d):
    both = table(spark, d, "documents").select("text").unionByName(table(spark, d, "benchmark").select("text"))
    return both.select(F.lower(F.trim(F.substring("text", 1, 40))).alias("task")).distinct()


@query("SELECT source, count(DISTINCT lang) AS n_tasks FROM documents GROUP BY source")
def distinct_tasks(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("n_tasks"))


@query(f"WITH {EGO_TELE} SELECT idx, task, 'ego' AS side FROM ego UNION ALL SELECT idx, task, 'tele' FROM tele")
def union_sides(spark, d):
    return vectors(spark, d, "ego").select("idx", "task", F.lit("ego").alias("side")).unionByName(vectors(spark, d, "tele").select("idx", "task", F.lit("tele").alias("side")))


@query("SELECT len(embedding)::INT AS dims, count(*) AS n, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-5) AS n_unit FROM embeddings GROUP BY 1")
def validate_dims(spark, d):
    rows = vectors(spark, d)
    return rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.count_if(F.abs(F.sqrt(dot(F.col("v"), F.col("v"))) - 1) < 1e-5).alias("n_unit"))


@query(f"WITH {EGO_TELE} SELECT a.idx, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS cosine, round(list_dot_product(a.v, b.v), 9) AS dot, round(list_distance(a.v, b.v), 9) AS euclidean, round(-list_distance(a.v, b.v), 9) AS neg_euclidean FROM e a JOIN e b ON b.idx = a.idx + 1")
def metric_dispatch(spark, d):
    a, b = vectors(spark, d).alias("a"), vectors(spark, d).alias("b")
    return a.join(b, F.col("b.idx") == F.col("a.idx") + 1).select("a.idx", *(F.round(similarity(F.col("a.v"), F.col("b.v"), m), 9).alias(m) for m in ("cosine", "dot", "euclidean", "neg_euclidean")))
