"""Queries on frames, segments, keys, paths and task texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from simloom.functions import text as fn
from simloom.operators import segments as op
from simloom.sources.tables import frames, table, vectors

from .base import EGO_TELE, FRAMES, Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

_TASKS = "tasks AS (SELECT DISTINCT event_type AS task_index, CASE WHEN event_type = 'view' THEN '' ELSE 'do ' || event_type END AS task FROM events)"
_RUNS = f"{FRAMES}, {_TASKS}, g AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode, task_index ORDER BY frame_index) AS isl FROM f), r AS (SELECT episode, task_index, min(frame_index) AS frame_start, max(frame_index) AS frame_end FROM g GROUP BY episode, task_index, isl HAVING max(frame_index) - min(frame_index) + 1 >= 2), runs AS (SELECT r.episode, r.task_index, task, frame_start, frame_end FROM r JOIN tasks USING (task_index) WHERE task <> '')"
_KEYS = "k AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN 'ep12' WHEN event_id % 13 = 0 THEN 'xp000001_fr000002' ELSE 'ep' || lpad(user_id::VARCHAR, 6, '0') || '_fr' || lpad(event_id::VARCHAR, 6, '0') END || CASE WHEN event_id % 2 = 0 THEN '.cam_high.jpg' ELSE '.meta.msgpack' END AS name FROM events)"


def _runs(spark, d):
    kind = F.col("event_type")
    tasks = table(spark, d, "events").select(kind.alias("task_index"), F.when(kind == "view", "").otherwise(F.concat(F.lit("do "), kind)).alias("task")).distinct()
    return op.segments_runs(frames(spark, d), tasks, least=2)


def _names(spark, d):
    rows = table(spark, d, "events")
    i = F.col("event_id")
    key = F.when(i % 11 == 0, "ep12").when(i % 13 == 0, "xp000001_fr000002").otherwise(F.concat(F.lit("ep"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit("_fr"), F.lpad(i.cast("string"), 6, "0")))
    return rows.select("event_id", "user_id", F.concat(key, F.when(i % 2 == 0, ".cam_high.jpg").otherwise(".meta.msgpack")).alias("name"))


@query("SELECT event_type, user_id FROM events WHERE value > 50")
def scan_project(spark, d):
    return table(spark, d, "events").where("value > 50").select("event_type", "user_id")


@query("SELECT user_id, event_type, CASE event_type WHEN 'click' THEN 'split1' WHEN 'view' THEN 'split2' ELSE 'split1' END AS split FROM events")
def split_map(spark, d):
    known = F.create_map(F.lit("click"), F.lit("split1"), F.lit("view"), F.lit("split2"))
    return table(spark, d, "events").select("user_id", "event_type", F.coalesce(F.try_element_at(known, F.col("event_type")), F.lit("split1")).alias("split"))


@query("SELECT user_id, arg_max(event_type, event_id) AS task FROM events GROUP BY user_id")
def dim_last_wins(spark, d):
    return op.last_wins(table(spark, d, "events"), "user_id", "event_type", "event_id").withColumnRenamed("event_type", "task")


@query(f"WITH {_KEYS}, m AS (SELECT event_id, name, split_part(name, '.', 1) AS key FROM k) SELECT event_id, key, split_part(name, '.', 2) AS cam, split_part(name, '.', 3) AS ext, TRY_CAST(nullif(regexp_extract(key, '^ep(\\d+)_fr(\\d+)$', 1), '') AS BIGINT) AS episode, TRY_CAST(nullif(regexp_extract(key, '^ep(\\d+)_fr(\\d+)$', 2), '') AS BIGINT) AS frame FROM m")
def parse_keys(spark, d):
    key = fn.member_key(F.col("name"))
    rest = F.split("name", r"\.")
    return _names(spark, d).select("event_id", key.alias("key"), rest[1].alias("cam"), rest[2].alias("ext"), fn.episode_of(key).alias("episode"), fn.frame_of(key).alias("frame"))


_META = "meta AS (SELECT 'src' || (user_id % 3) AS source, CASE WHEN event_id % 17 > 0 THEN user_id END AS episode, event_id // 2 AS frame, event_type AS task_index, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || (event_id % 3) END AS task, event_id AS pos FROM events), images AS (SELECT source, episode, frame, CASE WHEN pos % 3 > 0 THEN 'cam_high' ELSE 'cam_left' END AS camera FROM meta)"


@query(f"WITH {_META}, u AS (SELECT * FROM meta WHERE episode IS NOT NULL AND frame IS NOT NULL), s AS (SELECT DISTINCT source, episode, frame FROM images WHERE camera = 'cam_high'), g AS (SELECT source, episode, task_index, coalesce(arg_max(task, pos) FILTER (task <> ''), '') AS task FROM u GROUP BY ALL), fr AS (SELECT source, episode, task_index, list_sort(list(DISTINCT frame)) AS frame_indices FROM u JOIN s USING (source, episode, frame) GROUP BY ALL) SELECT * FROM g JOIN fr USING (source, episode, task_index)")
def segments_grouped(spark, d):
    i = F.col("event_id")
    meta = table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"), F.when(i % 17 > 0, F.col("user_id")).alias("episode"), F.floor(i / 2).alias("frame"), F.col("event_type").alias("task_index"), F.when(i % 4 == 0, "").otherwise(F.concat("event_type", (i % 3).cast("string"))).alias("task"), i.alias("pos"))
    images = meta.select("source", "episode", "frame", F.when(F.col("pos") % 3 > 0, "cam_high").otherwise("cam_left").alias("camera"))
    return op.segments_grouped(meta, images)


@query(f"WITH {_RUNS} SELECT * FROM runs")
def segments_runs(spark, d):
    return _runs(spark, d)


@query(f"WITH {_RUNS} SELECT episode, frame_start, frame_end, (frame_start + frame_end) // 2 AS mid FROM runs")
def mid_frame(spark, d):
    return _runs(spark, d).select("episode", "frame_start", "frame_end", F.expr("(frame_start + frame_end) DIV 2").alias("mid"))


_SPAN = "s AS (SELECT doc_id, doc_id % 50 AS a, doc_id % 50 + n_chars % 30 AS b FROM documents)"


def _spans(spark, d):
    a = F.col("doc_id") % 50
    return table(spark, d, "documents").select("doc_id", a.alias("a"), (a + F.col("n_chars") % 30).alias("b"))


@query(f"WITH {_SPAN} SELECT doc_id, CASE WHEN b - a + 1 <= 10 THEN range(a, b + 1) ELSE list_transform(range(0, 10), lambda i: a + floor(i * (b - a) / 9)::BIGINT) END AS frames FROM s")
def frame_sample(spark, d):
    return _spans(spark, d).select("doc_id", op.sample_frames(F.col("a"), F.col("b"), 10).alias("frames"))


@query(f"WITH {_SPAN}, l AS (SELECT doc_id, range(a, b + 1) AS f FROM s) SELECT doc_id, CASE WHEN len(f) >= 10 THEN list_transform(range(0, 9), lambda i: f[floor(i * (len(f) - 1) / 8)::BIGINT + 1]) ELSE f[1:9] END AS frames FROM l")
def pick9(spark, d):
    return _spans(spark, d).select("doc_id", op.pick9(F.sequence("a", "b")).alias("frames"))


@query(f"WITH {_SPAN} SELECT doc_id, b - a + 1 AS n_frames FROM s WHERE b - a + 1 >= 3")
def min_frames(spark, d):
    return _spans(spark, d).withColumn("frames", F.sequence("a", "b")).where(F.size("frames") >= 3).select("doc_id", F.size("frames").cast("long").alias("n_frames"))


@query(f"WITH {_RUNS} SELECT task, list({{'episode': episode, 'frame_start': frame_start}} ORDER BY episode, frame_start) AS segments FROM runs GROUP BY task")
def task_index(spark, d):
    return op.inverted_index(_runs(spark, d), "task", "episode", "frame_start")


@query("SELECT user_id % 5 AS task_name, event_type AS dataset_dir, list('tar' || event_id ORDER BY 'tar' || event_id) AS tars FROM events GROUP BY ALL")
def tar_index(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("task_name"), F.col("event_type").alias("dataset_dir")).agg(F.sort_array(F.collect_list(F.concat(F.lit("tar"), F.col("event_id").cast("string")))).alias("tars"))


@query("WITH p AS (SELECT page_id, string_split(url, '/') AS a, url FROM pages) SELECT page_id, CASE WHEN list_contains(a, '') AND len(a) >= list_position(a, '') + 1 THEN a[list_position(a, '') + 1] END AS host, CASE WHEN len(a) >= list_position(a, '') + 2 THEN a[list_position(a, '') + 2] END AS dataset_dir, CASE WHEN contains(url, 'example.org') THEN 'tele' ELSE 'ego' END AS dataset FROM p")
def parse_path(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", fn.path_part(url, "", 1).alias("host"), fn.path_part(url, "", 2).alias("dataset_dir"), fn.dataset_of(url, {"example.org": "tele"}, "ego").alias("dataset"))


@query("SELECT page_id, replace(regexp_replace(url, '^[a-z0-9]+://', ''), '/', '_') AS name FROM pages")
def safe_name(spark, d):
    return table(spark, d, "pages").select("page_id", fn.safe_name(F.col("url")).alias("name"))


@query("WITH f AS (SELECT url AS path, length(html) AS size, page_id AS mtime FROM pages), h AS (SELECT *, sum(size) OVER (ORDER BY mtime DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS held FROM f) SELECT * FROM h WHERE held > 50000")
def cache_evict(spark, d):
    return op.evictable(table(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").cast("long").alias("size"), F.col("page_id").alias("mtime")), 50000)


@query("SELECT doc_id, 'episode_' || lpad(doc_id::VARCHAR, 6, '0') AS episode, 'batch_' || lpad((n_chars % 1000)::VARCHAR, 4, '0') AS batch FROM documents")
def format_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("episode_"), F.lpad(F.col("doc_id").cast("string"), 6, "0")).alias("episode"), F.concat(F.lit("batch_"), F.lpad((F.col("n_chars") % 1000).cast("string"), 4, "0")).alias("batch"))


@query("SELECT doc_id, CASE WHEN length(text) > 55 THEN substr(text, 1, 55) || '…' ELSE text END AS short, substr(text, 1, 40) AS label FROM documents")
def truncate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.truncated(F.col("text"), 55).alias("short"), F.substring("text", 1, 40).alias("label"))


@query("WITH s AS (SELECT doc_id AS idx, CASE WHEN doc_id % 2 = 0 THEN '  ' || upper(lang) ELSE lang || ' ' END AS task FROM documents) SELECT idx, task FROM s WHERE lower(trim(task)) = 'de' ORDER BY idx LIMIT 20")
def task_lookup(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  "), F.upper("lang"))).otherwise(F.concat("lang", F.lit(" "))).alias("task"))
    return op.by_task(rows, " De ", 20)


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, k, sum(size + 1) OVER (PARTITION BY doc_id ORDER BY k) AS upto, size FROM (SELECT doc_id, generate_subscripts(words, 1) AS k, length(unnest(words)) AS size FROM w)),
n AS (SELECT a.doc_id, a.k, greatest(a.k, coalesce(b.k, 0)) AS last FROM t a ASOF LEFT JOIN t b ON a.doc_id = b.doc_id AND a.upto - a.size - 1 + 41 >= b.upto),
l AS (SELECT doc_id, list(last ORDER BY k) AS ends FROM n GROUP BY doc_id),
r AS (SELECT doc_id, ends, 1::BIGINT AS line, 1::BIGINT AS first FROM l UNION ALL SELECT doc_id, ends, line + 1, ends[first] + 1 FROM r WHERE ends[first] < len(ends))
SELECT w.doc_id, coalesce(x.lines, []) AS lines FROM w LEFT JOIN (SELECT r.doc_id, list(array_to_string(words[first:ends[first]], ' ') ORDER BY line) AS lines FROM r JOIN w USING (doc_id) GROUP BY r.doc_id) x USING (doc_id)""")
def word_wrap(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.wrapped(F.col("text"), 40).alias("lines"))


@query(f"WITH {EGO_TELE}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY md5('42|' || idx), idx) AS nth FROM e) SELECT idx, task FROM r WHERE nth = 1")
def one_per_task(spark, d):
    return op.one_per_task(vectors(spark, d).select("idx", "task"))


@query(f"WITH {EGO_TELE} SELECT idx, task FROM e ORDER BY md5('42|' || idx), idx LIMIT 50")
def hash_sample(spark, d):
    return op.hash_sample(vectors(spark, d).select("idx", "task"), 50)


@query(f"WITH {EGO_TELE} SELECT idx, task, row_number() OVER (ORDER BY ('0x' || substr(md5('42|' || idx), 1, 12))::BIGINT, idx) - 1 AS place FROM e")
def shuffle_rows(spark, d):
    rows = vectors(spark, d).select("idx", "task")
    return op.numbered(rows, op.seeded(42, F.col("idx")), "place", "idx")


@query(f"WITH {EGO_TELE}, n AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos, count(*) OVER () AS size FROM e), r AS (SELECT draw, ('0x' || substr(md5('42|' || draw), 1, 12))::BIGINT AS h FROM range(100) AS u(draw)) SELECT draw, idx, task FROM r JOIN n ON n.pos = r.h % n.size")
def replacement_draws(spark, d):
    return op.drawn_with_replacement(vectors(spark, d).select("idx", "task"), 100)
