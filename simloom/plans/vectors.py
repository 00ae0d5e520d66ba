"""Queries on single vectors, actions and position codes."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from simloom.functions import vector as fn
from simloom.operators import sequence
from simloom.sources.tables import frames, states, vectors

from .base import EGO_TELE, FRAMES, STATES, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

_PAIR = f"{EGO_TELE}, p AS (SELECT a.idx, a.v AS a, b.v AS b FROM e a JOIN e b ON b.idx = a.idx + 1)"
_ZERO = "CASE WHEN idx % 10 = 0 THEN list_transform(b, lambda x: 0.0::DOUBLE) ELSE b END"


def _pairs(spark, d):
    a, b = vectors(spark, d).alias("a"), vectors(spark, d).alias("b")
    return a.join(b, F.col("b.idx") == F.col("a.idx") + 1).select("a.idx", F.col("a.v").alias("a"), F.col("b.v").alias("b"))


def _nine(v):
    return F.transform(v, lambda x: F.round(x, 9))


def _unit(sql: str) -> str:
    return f"list_transform({sql}, lambda x: round(x / greatest(sqrt(list_dot_product({sql}, {sql})), 1e-12), 9))"


@query(f"WITH {_PAIR}, z AS (SELECT idx, a, {_ZERO} AS b FROM p) SELECT idx, CASE WHEN list_dot_product(b, b) = 0 THEN 0 ELSE round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9) END AS cosine FROM z")
def cosine(spark, d):
    zero = F.when(F.col("idx") % 10 == 0, F.transform("b", lambda x: F.lit(0.0))).otherwise(F.col("b"))
    return _pairs(spark, d).select("idx", F.round(fn.cosine(F.col("a"), zero), 9).alias("cosine"))


@query(f"WITH {_PAIR} SELECT idx, round(list_distance(a, b), 9) AS euclidean FROM p")
def euclidean(spark, d):
    return _pairs(spark, d).select("idx", F.round(fn.euclidean(F.col("a"), F.col("b")), 9).alias("euclidean"))


@query(f"WITH {_PAIR} SELECT idx, round(-list_distance(a, b), 9) AS neg_euclidean FROM p")
def neg_euclidean(spark, d):
    return _pairs(spark, d).select("idx", F.round(fn.neg_euclidean(F.col("a"), F.col("b")), 9).alias("neg_euclidean"))


@query(f"WITH {EGO_TELE}, s AS (SELECT idx, list_transform(v, lambda x: x * 3) AS v FROM e) SELECT idx, {_unit('v')} AS v FROM s")
def l2_normalize(spark, d):
    return vectors(spark, d).select("idx", _nine(fn.l2_normalize(F.transform("v", lambda x: x * 3))).alias("v"))


@query(f"WITH {_PAIR}, s AS (SELECT idx, list_transform(list_zip(a, b), lambda z: z[1] * 0.7::DOUBLE + z[2] * (1 - 0.7::DOUBLE)) AS v FROM p) SELECT idx, {_unit('v')} AS v FROM s")
def vl_blend(spark, d):
    return _pairs(spark, d).select("idx", _nine(fn.blend(F.col("a"), F.col("b"))).alias("v"))


@query(f"WITH {_PAIR}, s AS (SELECT idx, list_concat(a, b) AS v FROM p) SELECT idx, {_unit('v')} AS v FROM s")
def fuse_concat(spark, d):
    return _pairs(spark, d).select("idx", _nine(fn.fuse_concat(F.col("a"), F.col("b"))).alias("v"))


@query(f"WITH {_PAIR}, s AS (SELECT idx, list_transform(list_zip(a, b), lambda z: z[1] + z[2]) AS v FROM p) SELECT idx, {_unit('v')} AS v FROM s")
def fuse_add(spark, d):
    return _pairs(spark, d).select("idx", _nine(fn.fuse_add(F.col("a"), F.col("b"))).alias("v"))


@query(f"WITH {_PAIR}, w AS (SELECT (1 / (1 + exp(-0.7::DOUBLE))) / (1 / (1 + exp(-0.7::DOUBLE)) + 1 / (1 + exp(-0.3::DOUBLE))) AS x), s AS (SELECT idx, list_transform(list_zip(a, b), lambda z: z[1] * w.x + z[2] * (1 - w.x)) AS v FROM p, w) SELECT idx, {_unit('v')} AS v FROM s")
def fuse_weighted(spark, d):
    return _pairs(spark, d).select("idx", _nine(fn.fuse_weighted(F.col("a"), F.col("b"), 0.7, 0.3)).alias("v"))


@query(f"WITH {FRAMES}, s AS (SELECT episode, list(value ORDER BY frame_index) AS v FROM f GROUP BY episode), m AS (SELECT max(len(v)) AS n FROM s) SELECT episode, list_concat(v, list_transform(range(0, (n - len(v))::BIGINT), lambda i: 0.0::DOUBLE)) AS v FROM s, m")
def pad_sequences(spark, d):
    rows = frames(spark, d).groupBy("episode").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "value"))), lambda x: x["value"]).alias("v"))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.select("episode", fn.pad(F.col("v"), F.lit(longest)).alias("v"))


@query(f"WITH {EGO_TELE}, u AS (SELECT task, generate_subscripts(v, 1) AS p, unnest(v) AS x FROM e) SELECT task, list(m ORDER BY p) AS v FROM (SELECT task, p, round(avg(x), 9) AS m FROM u GROUP BY task, p) GROUP BY task")
def mean_pool(spark, d):
    means = vectors(spark, d).groupBy("task").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("v"))
    return means.select("task", F.transform("v", lambda x: F.round(x, 9)).alias("v"))


@query(f"WITH {FRAMES}, c AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 7 = 1 THEN 'Infinity'::DOUBLE WHEN event_id % 7 = 2 THEN '-Infinity'::DOUBLE ELSE value END AS x FROM f) SELECT event_id, CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END AS clean, CASE WHEN isnan(x) OR x = '-Infinity'::DOUBLE THEN 0 WHEN x = 'Infinity'::DOUBLE THEN 1e10 ELSE x END AS cost FROM c")
def nan_clean(spark, d):
    k = F.col("event_id") % 7
    x = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("value"))
    return frames(spark, d).select("event_id", fn.clean(x).alias("clean"), fn.clean_cost(x).alias("cost"))


_CHUNKS = f"{FRAMES}, ch AS (SELECT episode, frame_index AS start, [value, value * 0.9::DOUBLE, value * 0.8::DOUBLE, value * 0.7::DOUBLE] AS actions FROM f)"


def _chunks(spark, d):
    return frames(spark, d).select("episode", F.col("frame_index").alias("start"), F.array(*(F.col("value") * w for w in (1.0, 0.9, 0.8, 0.7))).alias("actions"))


@query(f"WITH {_CHUNKS}, s AS (SELECT episode, start, start + k AS step, actions[k + 1] AS action FROM ch, unnest(range(0, 4)) AS u(k)), a AS (SELECT *, exp(-0.01::DOUBLE * (row_number() OVER (PARTITION BY episode, step ORDER BY start) - 1)) AS w FROM s) SELECT episode, step, count(*) AS n, round(sum(action * w) / sum(w), 6) AS action FROM a GROUP BY episode, step")
def temporal_ensemble(spark, d):
    return sequence.temporal_ensemble(_chunks(spark, d))


@query(f"WITH {_CHUNKS} SELECT f.episode, f.frame_index AS step, (f.frame_index // 4) * 4 AS start, actions[f.frame_index % 4 + 1] AS action FROM f JOIN ch ON ch.episode = f.episode AND ch.start = (f.frame_index // 4) * 4")
def action_queue(spark, d):
    return sequence.action_queue(frames(spark, d).select("episode", F.col("frame_index").alias("step")), _chunks(spark, d), 4)


@query(f"WITH {STATES} SELECT count(*) AS n, round(avg(abs(a - 20 * (1 + c)) * (NOT (fr % 5 = 4))::INT), 6) AS l1 FROM t")
def masked_l1(spark, d):
    return sequence.masked_l1(states(spark, d).select(F.col("a").alias("target"), (20 * (1 + F.col("c"))).alias("predicted"), (F.col("fr") % 5 == 4).alias("is_pad")))


@query(f"WITH {STATES}, r AS (SELECT seg, sum(-0.5 * (1 + d - c * c - exp(d))) AS k FROM t GROUP BY seg) SELECT round(avg(k), 6) AS kl, round(0.5 + 10 * avg(k), 6) AS loss FROM r")
def kl_loss(spark, d):
    return sequence.kl_loss(states(spark, d).select(F.col("seg").alias("row"), F.col("c").alias("mu"), F.col("d").alias("log_var")), l1=0.5)


@query(f"WITH {FRAMES} SELECT event_id, frame_index AS pos, list_transform(range(0, 32), lambda k: round(CASE WHEN k % 2 = 0 THEN sin(frame_index / pow(10000.0, 2 * (k // 2) / 32.0)) ELSE cos(frame_index / pow(10000.0, 2 * (k // 2) / 32.0)) END, 9)) AS code FROM f")
def sinusoid_pe(spark, d):
    """The code of each frame's position in its episode."""
    code = F.transform(sequence.position_code(F.col("frame_index"), 32), lambda x: F.round(x, 9))
    return frames(spark, d).select("event_id", F.col("frame_index").alias("pos"), code.alias("code"))
