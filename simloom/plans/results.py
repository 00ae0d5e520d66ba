"""Queries on what goes to results and comes back, on lookups beside them, and on encoder heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import layers
from simloom.functions.vector import rounded
from simloom.operators import pairing, segments
from simloom.operators import sequence as seq
from simloom.operators.similarity import topk
from simloom.sources import results
from simloom.sources.tables import frames, table, vectors

from .base import CROSS, EGO_TELE, FRAMES, Registry
from .pairing import _BATCHES, _batches, _matrix
from .similarity import NEGATIVE, POSITIVE

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT page_id, url FROM pages")
def drop_images(spark, d):
    return results.without(table(spark, d, "pages"), "html", "cam_images")


@query(f"WITH {CROSS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM x) SELECT i AS query_idx, ti AS query_task, list({{'rank': rank::INT, 'idx': j, 'task': tj, 'sim': s}} ORDER BY rank) AS top_k FROM r WHERE rank <= 5 GROUP BY ALL")
def topk_records(spark, d):
    """The nested rows that a JSON result of a top-k search has."""
    match = F.struct("rank", F.col("match_idx").alias("idx"), F.col("match_task").alias("task"), "sim")
    return topk(vectors(spark, d, "ego"), vectors(spark, d, "tele"), 5).groupBy("query_idx", "query_task").agg(F.sort_array(F.collect_list(match)).alias("top_k"))


_RECORDS = f"{_BATCHES}, dg AS (SELECT batch_id, round(avg(sim), 6) AS diag_mean, round(min(sim), 6) AS diag_min, round(max(sim), 6) AS diag_max FROM m WHERE i = j GROUP BY 1), li AS (SELECT batch_id, i, list(sim ORDER BY j) AS sims FROM m GROUP BY 1, 2), sm AS (SELECT batch_id, list(sims ORDER BY i) AS sim_matrix FROM li GROUP BY 1), br AS (SELECT batch_id, count(*)::INT AS n_ego, count(*)::INT AS n_tele, list(ego_idx ORDER BY slot) AS ego, list(tele_idx ORDER BY slot) AS tele FROM b GROUP BY 1), rec AS (SELECT br.*, diag_mean, diag_min, diag_max, sim_matrix FROM br JOIN dg USING (batch_id) JOIN sm USING (batch_id))"


def _records(spark, d):
    return results.batch_records(_batches(spark, d), _matrix(spark, d))


@query(f"WITH {_RECORDS} SELECT * FROM rec")
def batch_records(spark, d):
    return _records(spark, d)


@query(f"WITH {_RECORDS} SELECT count(*) AS n_batches, max(n_ego) AS batch_size, sum(n_ego)::BIGINT AS ego_used, sum(n_tele)::BIGINT AS tele_used, round(avg(diag_mean), 6) AS mean, round(stddev_pop(diag_mean), 6) AS std, round(avg(diag_min), 6) AS mean_min, {', '.join(f'round(quantile_cont(diag_mean, {x / 100}), 6) AS p{x}' for x in (10, 25, 50, 75, 90))} FROM rec")
def batches_info(spark, d):
    return results.batches_summary(_records(spark, d))


def _bins(kind: str, where: str, bins: int) -> str:
    return f"SELECT m.batch_id, '{kind}' AS kind, CASE WHEN hi = lo THEN 0 ELSE least(floor((sim - lo) / ((hi - lo) / {bins})), {bins - 1}) END::INT AS bin, count(*) AS n FROM m JOIN (SELECT batch_id, min(sim) AS lo, max(sim) AS hi FROM m WHERE {where} GROUP BY 1) e ON e.batch_id = m.batch_id WHERE {where} GROUP BY ALL"


@query(f"WITH {_BATCHES} {_bins('all', 'true', 20)} UNION ALL {_bins('diagonal', 'i = j', 10)}")
def batch_histograms(spark, d):
    """Of each batch, all similarities in 20 bins and those of its pairs in 10."""
    out = None
    for kind, where, bins in (("all", "true", 20), ("diagonal", "i = j", 10)):
        rows = _matrix(spark, d).where(where)
        ends = rows.groupBy("batch_id").agg(F.min("sim").alias("low"), F.max("sim").alias("high"))
        width = (F.col("high") - F.col("low")) / bins
        number = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("sim") - F.col("low")) / width), F.lit(bins - 1))).cast("int")
        part = rows.join(ends, "batch_id").groupBy("batch_id", F.lit(kind).alias("kind"), number.alias("bin")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("WITH s AS (SELECT DISTINCT user_id AS episode, event_type AS task_index FROM events), t AS (SELECT user_id AS episode, event_type AS task_index, 'tar' || min(event_id) AS tar FROM events WHERE value > 50 GROUP BY ALL) SELECT * FROM s JOIN t USING (episode, task_index)")
def segment_tar(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("episode"), F.col("event_type").alias("task_index"), "event_id", "value")
    found = rows.where("value > 50").groupBy("episode", "task_index").agg(F.concat(F.lit("tar"), F.min("event_id").cast("string")).alias("tar"))
    return segments.with_tar(rows.select("episode", "task_index").distinct(), found)


@query(f"WITH {EGO_TELE}, p AS (SELECT label, vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) SELECT e.idx, e.v, p.label FROM e JOIN p ON p.pos = e.idx")
def aligned_metadata(spark, d):
    """Vectors with the metadata that has the same place in its list."""
    rows = table(spark, d, "embeddings")
    places = segments.numbered(rows.select("vec_id", "label"), "vec_id", "place")
    return vectors(spark, d).select("idx", "v").join(places.select(F.col("place").alias("idx"), "label"), "idx")


@query("SELECT user_id % 7 AS episode, event_type AS dataset_dir, min('chunk-' || lpad((event_id % 13)::VARCHAR, 3, '0') || '/episode_' || lpad((user_id % 7)::VARCHAR, 6, '0') || '.mp4') AS video FROM events GROUP BY ALL")
def video_chunk(spark, d):
    rows = table(spark, d, "events")
    name = F.format_string("chunk-%03d/episode_%06d.mp4", F.col("event_id") % 13, F.col("user_id") % 7)
    return segments.first_chunk(rows.select((F.col("user_id") % 7).alias("episode"), F.col("event_type").alias("dataset_dir"), name.alias("path")), "episode", "dataset_dir")


@query("SELECT DISTINCT unnest([coalesce(CASE WHEN doc_id % 3 > 0 THEN source END, 'ego'), coalesce(CASE WHEN doc_id % 5 > 0 THEN lang END, 'tele')]) AS dataset FROM documents")
def pair_datasets(spark, d):
    i = F.col("doc_id")
    return segments.datasets_of(table(spark, d, "documents").select(F.when(i % 3 > 0, F.col("source")).alias("dataset_a"), F.when(i % 5 > 0, F.col("lang")).alias("dataset_b")), "ego", "tele")


@query(f"WITH {CROSS}, p AS (SELECT i, j, s AS sim, (s >= {POSITIVE})::INT AS label FROM x WHERE s >= {POSITIVE} OR s <= {NEGATIVE}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || i || '|' || j), i, j) AS nth FROM p) SELECT i, j, sim, label FROM r WHERE label = 1 OR nth <= floor((SELECT count(*) FROM p WHERE label = 1) * 1.5)")
def balanced_pairs(spark, d):
    return pairing.balanced_pairs_of(vectors(spark, d, "ego"), vectors(spark, d, "tele"), POSITIVE, NEGATIVE, 1.5)


_SEED = "('0x' || substr(md5(concat_ws('|', '42', {})), 1, 12))::BIGINT"


@query(f"WITH {EGO_TELE}, tp AS (SELECT DISTINCT a.task AS te, b.task AS tt FROM ego a, tele b WHERE a.task = b.task AND a.task < 5), o AS (SELECT *, row_number() OVER (ORDER BY {_SEED.format('te, tt')}, te, tt) - 1 AS k FROM tp), n AS (SELECT count(*) AS n FROM (SELECT * FROM o WHERE k < 8)), w AS (SELECT slot::INT AS slot, te, tt FROM range(8) AS u(slot), n JOIN o ON true WHERE o.k = slot % n), c AS (SELECT slot, 'ego' AS side, idx, task, row_number() OVER (PARTITION BY slot ORDER BY {_SEED.format('slot, idx')}, idx) AS nth FROM w JOIN ego ON task = te UNION ALL SELECT slot, 'tele', idx, task, row_number() OVER (PARTITION BY slot ORDER BY {_SEED.format('slot, idx')}, idx) FROM w JOIN tele ON task = tt) SELECT slot, side, idx, task, false AS filled FROM c WHERE nth = 1")
def matched_rows(spark, d):
    ego, tele = vectors(spark, d, "ego"), vectors(spark, d, "tele")
    tasks = ego.select(F.col("task").alias("ego_task")).distinct().where("ego_task < 5").join(tele.select(F.col("task").alias("tele_task")).distinct(), F.col("ego_task") == F.col("tele_task"))
    return pairing.matched_batch(tasks, ego, tele, 16, in_turn=True).withColumn("filled", F.lit(False))


@query(f"WITH {FRAMES} SELECT event_id, list_concat(list_transform(range(0, 8), lambda k: round(CASE WHEN k % 2 = 0 THEN sin((frame_index // 7 % 5 + 1) / (5 + 1e-6) * 2 * pi() / pow(10000.0, 2 * (k // 2) / 8.0)) ELSE cos((frame_index // 7 % 5 + 1) / (5 + 1e-6) * 2 * pi() / pow(10000.0, 2 * (k // 2) / 8.0)) END, 9)), list_transform(range(0, 8), lambda k: round(CASE WHEN k % 2 = 0 THEN sin((frame_index % 7 + 1) / (7 + 1e-6) * 2 * pi() / pow(10000.0, 2 * (k // 2) / 8.0)) ELSE cos((frame_index % 7 + 1) / (7 + 1e-6) * 2 * pi() / pow(10000.0, 2 * (k // 2) / 8.0)) END, 9))) AS code FROM f")
def sinusoid_pe_2d(spark, d):
    """The code of each frame's cell, frames standing in rows of seven."""
    at = F.col("frame_index")
    code = F.transform(seq.position_code_2d(F.expr("frame_index DIV 7 % 5"), at % 7, 5, 7, 8), lambda x: F.round(x, 9))
    return frames(spark, d).select("event_id", code.alias("code"))


@query(f"WITH {EGO_TELE} SELECT idx, list_transform(v, lambda x: round(greatest(x, 0), 9)) AS relu, list_transform(range(1, 33), lambda k: round(v[k] / (1 + exp(-v[k + 32])), 9)) AS glu FROM e")
def activations(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("idx", *(F.transform(layers.activation(v, n), lambda x: F.round(x, 9)).alias(n) for n in ("relu", "glu")))


@query(f"WITH {EGO_TELE} SELECT idx, list_transform(v, lambda x: round((x - list_avg(v)) / sqrt(list_var_pop(v) + 1e-5), 9)) AS normed FROM e")
def layer_norm(spark, d):
    return vectors(spark, d).select("idx", F.transform(layers.layer_norm(F.col("v")), lambda x: rounded(x, 9)).alias("normed"))
