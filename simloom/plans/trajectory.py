"""Queries on trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions.vector import rounded
from simloom.operators import trajectory as op
from simloom.sources.tables import states, vectors

from .base import EGO_TELE, STATES, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

WEIGHTS = [1.0, 0.001, 5.0, 5.0]
_TRAJ = f"{STATES}, tr AS (SELECT seg, count(*) AS n_frames, list([a, b, c, d] ORDER BY fr) AS states FROM t GROUP BY seg)"


def _trajectories(spark, d):
    return op.trajectories(states(spark, d), "seg", "fr", F.array("a", "b", "c", "d"))


def _pairs(spark, d):
    """Each trajectory with the one after it; some partners are missing."""
    t = _trajectories(spark, d)
    a = t.select("seg", F.col("states").alias("states_a"))
    b = t.select((F.col("seg") - 1).alias("seg"), F.col("states").alias("states_b"))
    return a.join(b, "seg", "left")


@query(f"WITH {_TRAJ} SELECT seg, n_frames, states FROM tr")
def trajectory_extract(spark, d):
    rows = states(spark, d)
    segments = rows.groupBy("seg").agg(F.sort_array(F.collect_list("fr")).alias("frame_indices")).withColumn("episode", F.col("seg"))
    return op.extract(segments, rows.select(F.col("seg").alias("episode"), F.col("fr").alias("frame"), "a", "b", "c", "d"), F.array("a", "b", "c", "d"))


@query(f"WITH {STATES} SELECT seg, fr, CASE WHEN fr % 5 = 3 THEN [a, 0, c, d] ELSE [a, b, c, d] END AS state FROM t WHERE fr % 7 < 6")
def state_vector(spark, d):
    first = F.when(F.col("fr") % 5 == 3, F.array("a")).otherwise(F.array("a", "b"))
    second = F.when(F.col("fr") % 7 < 6, F.array("c", "d", "a"))
    return states(spark, d).select("seg", "fr", op.state_vector([(first, 2), (second, 2)]).alias("state")).where("state IS NOT NULL")


@query(f"WITH {EGO_TELE}, w AS (SELECT list_concat(list_transform(range(0, 12), lambda i: 1.0::DOUBLE), list_concat(list_transform(range(0, 6), lambda i: 0.3::DOUBLE), [0.5, 0.5, 0.2, 0.2, 0.2]::DOUBLE[])) AS w) SELECT idx, list_transform(range(1, 24), lambda i: round(v[i] * w[i], 9)) AS weighted FROM e, w")
def weight_vector(spark, d):
    """The first values of each vector, as a state, times the weights of a state's parts."""
    weights = F.array(*map(F.lit, op.weight_vector()))
    return vectors(spark, d).select("idx", F.zip_with(F.slice("v", 1, len(op.weight_vector())), weights, lambda x, w: F.round(x * w, 9)).alias("weighted"))


def _scale(low: str, spread: str) -> str:
    cells = ", ".join(f"round(CASE WHEN count(*) OVER w < 2 THEN {c} ELSE ({c} - {low.format(c)}) / CASE WHEN {spread.format(c)} < 1e-8 THEN 1 ELSE {spread.format(c)} END END, 6) + 0.0 AS {c}" for c in "abcd")
    return f"WITH {STATES} SELECT seg, fr, {cells} FROM t WINDOW w AS (PARTITION BY seg)"


@query(_scale("avg({0}) OVER w", "stddev_pop({0}) OVER w"))
def traj_zscore(spark, d):
    return op.scaled(states(spark, d), "seg", list("abcd"), "zscore").withColumns({c: F.round(c, 6) + 0.0 for c in "abcd"})


@query(_scale("min({0}) OVER w", "(max({0}) OVER w - min({0}) OVER w)"))
def traj_minmax(spark, d):
    return op.scaled(states(spark, d), "seg", list("abcd"), "minmax").withColumns({c: F.round(c, 6) + 0.0 for c in "abcd"})


@query(f"WITH {STATES} SELECT x.seg, x.fr, round(sqrt(1.0 * (x.a - y.a) ** 2 + 0.001 * (x.b - y.b) ** 2 + 5 * (x.c - y.c) ** 2 + 5 * (x.d - y.d) ** 2), 6) AS distance FROM t x JOIN t y ON x.seg = y.seg AND y.fr = x.fr + 1")
def frame_distance(spark, d):
    x = states(spark, d)
    y = x.select("seg", (F.col("fr") - 1).alias("fr"), *(F.col(c).alias(f"{c}2") for c in "abcd"))
    gap = F.sqrt(sum((F.lit(w) * (F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c, w in zip("abcd", WEIGHTS)), F.lit(0.0)))
    return x.join(y, ["seg", "fr"]).select("seg", "fr", F.round(gap, 6).alias("distance"))


_INTERP = f"""{_TRAJ}, p AS (SELECT x.seg, x.states AS sa, y.states AS sb FROM tr x JOIN tr y ON y.seg = x.seg + 1),
k AS (SELECT seg, sa, sb, k, k * (len(sa) - 1) / 99.0::DOUBLE AS pa, k * (len(sb) - 1) / 99.0::DOUBLE AS pb FROM p, unnest(range(0, 100)) AS u(k)),
l AS (SELECT *, least(floor(pa), greatest(len(sa) - 2, 0))::BIGINT AS la, least(floor(pb), greatest(len(sb) - 2, 0))::BIGINT AS lb FROM k),
g AS (SELECT seg, list_transform([1, 2, 3, 4], lambda d: (sa[la + 1][d] * (1 - (pa - la)) + sa[least(la + 2, len(sa))][d] * (pa - la)) - (sb[lb + 1][d] * (1 - (pb - lb)) + sb[least(lb + 2, len(sb))][d] * (pb - lb))) AS z FROM l)"""


@query(f"WITH {_INTERP} SELECT seg, round(avg(sqrt(z[1] ** 2 + 0.001 * z[2] ** 2 + 5 * z[3] ** 2 + 5 * z[4] ** 2)), 6) AS distance FROM g GROUP BY seg")
def interp_euclidean(spark, d):
    pairs = _pairs(spark, d).where("states_b IS NOT NULL")
    return op.interp_euclidean(pairs, WEIGHTS).withColumn("distance", rounded(F.col("distance"), 6))


def _dtw(weights: str, band: str) -> str:
    """SQL of the warped distance of ``pp`` ``(seg, n, m, xa, xb)``: a row for each pair and anti-diagonal, of which two are carried as lists by frame."""
    cell = f"sqrt({' + '.join(f'{w} * (xa[i][{k}] - xb[d - i][{k}]) ** 2' for k, w in enumerate(weights.split(), 1))})"
    none = "{'t': 'Infinity'::DOUBLE, 'l': 0::BIGINT}"
    way = "CASE WHEN p2[i].t <= p1[i].t AND p2[i].t <= p1[i + 1].t THEN p2[i] WHEN p1[i].t <= p1[i + 1].t THEN p1[i] ELSE p1[i + 1] END"
    step = f"list_transform(range(0, n + 1), lambda i: CASE WHEN i < 1 OR d - i < 1 OR d - i > m OR abs(2 * i - d) > band THEN {none} ELSE {{'t': {cell} + ({way}).t, 'l': 1 + ({way}).l}} END)"
    return f"""bb AS (SELECT seg, n, m, xa, xb, greatest(CASE WHEN {band} > 0 THEN {band} ELSE greatest(n, m) END, abs(n - m)) AS band FROM pp),
w AS (SELECT seg, n, m, xa, xb, band, 2::BIGINT AS d, list_transform(range(0, n + 1), lambda i: {none}) AS p1, list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN {{'t': 0.0::DOUBLE, 'l': 0::BIGINT}} ELSE {none} END) AS p2 FROM bb
  UNION ALL SELECT seg, n, m, xa, xb, band, d + 1, {step}, p1 FROM w WHERE d <= n + m),
f AS (SELECT seg, p1[n + 1].t AS far, p1[n + 1].l AS path FROM w WHERE d = n + m + 1)"""


_BOTH = "all_pairs AS (SELECT x.seg, x.states AS sa, y.states AS sb FROM tr x LEFT JOIN tr y ON y.seg = x.seg + 1)"
_OUT = "coalesce(round(far, 6), 'Infinity'::DOUBLE) AS dtw_distance, coalesce(path, 0) AS dtw_path, coalesce(round(far / greatest(path, 1), 6), 'Infinity'::DOUBLE) AS dtw_normalised"


@query(f"WITH RECURSIVE {_TRAJ}, {_BOTH}, pp AS (SELECT seg, sa AS xa, sb AS xb, len(sa) AS n, len(sb) AS m FROM all_pairs WHERE sb IS NOT NULL), {_dtw('1.0 0.001 5.0 5.0', '0')} SELECT a.seg, {_OUT} FROM all_pairs a LEFT JOIN f USING (seg)")
def dtw(spark, d):
    return op.compare(_pairs(spark, d), WEIGHTS, how="none", window_ratio=0.0).select("seg", "dtw_distance", "dtw_path", "dtw_normalised")


def _scaled(column: str) -> str:
    mean = "list_avg(list_transform({0}, lambda r: r[k]))"
    std = "coalesce(list_stddev_pop(list_transform({0}, lambda r: r[k])), 0)"
    cells = ", ".join(f"(s[{k}] - {mean}) / CASE WHEN {std} < 1e-8 THEN 1 ELSE {std} END".replace("r[k]", f"r[{k}]") for k in range(1, 5))
    return f"CASE WHEN len({column}) < 2 THEN {column} ELSE list_transform({column}, lambda s: [{cells}]) END".format(column)


_ZIE = """k AS (SELECT seg, xa AS sa, xb AS sb, k, k * (n - 1) / 99.0::DOUBLE AS pa, k * (m - 1) / 99.0::DOUBLE AS pb FROM pp, unnest(range(0, 100)) AS u(k)),
l AS (SELECT *, least(floor(pa), greatest(len(sa) - 2, 0))::BIGINT AS la, least(floor(pb), greatest(len(sb) - 2, 0))::BIGINT AS lb FROM k),
g AS (SELECT seg, list_transform([1, 2, 3, 4], lambda d: (sa[la + 1][d] * (1 - (pa - la)) + sa[least(la + 2, len(sa))][d] * (pa - la)) - (sb[lb + 1][d] * (1 - (pb - lb)) + sb[least(lb + 2, len(sb))][d] * (pb - lb))) AS z FROM l),
ie AS (SELECT seg, avg(sqrt(z[1] ** 2 + 0.001 * z[2] ** 2 + 5 * z[3] ** 2 + 5 * z[4] ** 2)) AS even FROM g GROUP BY seg)"""


@query(f"WITH RECURSIVE {_TRAJ}, {_BOTH}, z AS (SELECT seg, {_scaled('states')} AS states FROM tr), pp AS (SELECT x.seg, x.states AS xa, y.states AS xb, len(x.states) AS n, len(y.states) AS m FROM z x JOIN z y ON y.seg = x.seg + 1), {_dtw('1.0 0.001 5.0 5.0', 'floor(greatest(n, m) * 0.2::DOUBLE)::BIGINT')}, {_ZIE} SELECT a.seg, {_OUT}, coalesce(round(even, 6), 'Infinity'::DOUBLE) AS interp_distance, coalesce(pp.n, 0) AS len_a, coalesce(pp.m, 0) AS len_b, CASE WHEN pp.n IS NULL THEN 0 ELSE 4 END::BIGINT AS dim FROM all_pairs a LEFT JOIN f USING (seg) LEFT JOIN ie USING (seg) LEFT JOIN pp USING (seg)")
def traj_similarity(spark, d):
    return op.compare(_pairs(spark, d), WEIGHTS)


_RESULTS = "r AS (SELECT vec_id AS idx, CASE WHEN vec_id % 10 = 0 THEN 'Infinity'::DOUBLE ELSE abs(embedding[1]::DOUBLE) END AS interp, abs(embedding[2]::DOUBLE) AS far, embedding[3]::DOUBLE AS sim, CASE WHEN vec_id % 13 = 0 THEN 'no frames' END AS error FROM embeddings)"


def _results(spark, d):
    from simloom.sources.tables import vectors

    at = lambda k: F.element_at("v", k)
    i = F.col("idx")
    return vectors(spark, d).select("idx", F.when(i % 10 == 0, F.lit(float("inf"))).otherwise(F.abs(at(1))).alias("interp"), F.abs(at(2)).alias("far"), at(3).alias("sim"), F.when(i % 13 == 0, "no frames").alias("error"))


@query(f"WITH {_RESULTS}, m AS (SELECT 'interp' AS metric, interp AS x, error FROM r UNION ALL SELECT 'far', far, error FROM r), o AS (SELECT metric, error, CASE WHEN error IS NULL AND x <> 'Infinity'::DOUBLE THEN x END AS x FROM m) SELECT metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS largest, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.75), 6) AS p75, count(*) FILTER (error IS NULL) AS n_valid, count(*) FILTER (error IS NOT NULL) AS n_error, count(*) AS n_total FROM o GROUP BY metric")
def traj_summary(spark, d):
    return op.summary(_results(spark, d), ["interp", "far"])


@query(f"WITH {_RESULTS} SELECT count(*) AS n, CASE WHEN count(*) > 2 THEN round(corr(sim, interp), 6) END AS corr FROM r WHERE error IS NULL AND interp <> 'Infinity'::DOUBLE AND sim <> 'Infinity'::DOUBLE")
def visual_dtw_corr(spark, d):
    return op.correlation(_results(spark, d), "sim", "interp")
