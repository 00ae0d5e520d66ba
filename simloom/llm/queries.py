"""The queries opN_<name> and their SQL: thin applications of the operators to whole tables.

Nulls, empty and long texts, ties, repeated rows and empty tables have the results that the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches
from .decontaminate import contamination
from .divergence import source_divergence
from .exact_dedup import exact_dedup
from .langid import language_id
from .lexical import lexical_search
from .line_dedup import line_report
from .lm_score import lm_scores
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .token_files import token_files
from .toxicity import toxicity_scores
from .url_filter import judge_urls, path_of
from .warc import write_archive

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies among all documents."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).drop("root")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document whose number a page's path has: block if it is toxic or of low quality."""
    pages = _table(spark, sf_dir, "pages")
    number = F.regexp_extract(path_of(F.col("url")), "([0-9]{1,18})", 1).try_cast("long")
    marks = _table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow").alias("label"))
    labels = pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "label")
    return judge_urls(pages, labels)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, found by its url in the index."""
    pages = _table(spark, sf_dir, "pages")
    return write_archive(pages).read(pages)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the counts of all documents."""
    return lm_scores(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands in the benchmark."""
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of each document with lines of ten documents or more."""
    return line_report(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those that are not held out."""
    return language_id(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document, learned from labels that are not held out."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents' ids, out of the files that hold them."""
    import public_tokenizers

    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).digests()


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of each language differ."""
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item of the benchmark."""
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_url_filters, op3_warc, op4_lm_scoring, op5_exact_dedup, op6_benchmark_decontamination, op7_line_dedup, op8_language_id, op9_toxicity, op10_mixing, op11_token_ids, op12_source_divergence, op13_lexical_search)}

SQL = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) ELSE [array_to_string(a, ' ')] END) AS g FROM w WHERE len(a) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sig AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS sig FROM s GROUP BY doc_id),
rep AS (SELECT sig, min(doc_id) AS rep FROM sig GROUP BY sig),
r AS (SELECT s.doc_id, s.g FROM s JOIN rep ON s.doc_id = rep.rep),
common AS (SELECT g FROM r GROUP BY g HAVING count(*) > 1),
c AS (SELECT r.doc_id, r.g FROM r JOIN common USING (g)),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))
), sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rep AS x, rep AS y FROM rep UNION SELECT reach.x, sides.y FROM reach JOIN sides ON reach.y = sides.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.component_id, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN sig USING (doc_id) LEFT JOIN rep USING (sig) LEFT JOIN comp ON comp.x = rep.rep
""",
    "op3_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(p.h, ((k // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN m USING (h)
""",
    "op4_lm_scoring": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
t AS (SELECT doc_id, a[i] AS x, CASE WHEN i > 1 THEN a[i - 1] END AS b, CASE WHEN i > 2 THEN a[i - 2] END AS c, i FROM w, unnest(range(1, len(a) + 1)) AS u(i)),
c1 AS (SELECT x, count(*) AS n FROM t GROUP BY x), c2 AS (SELECT b, x, count(*) AS n FROM t WHERE i > 1 GROUP BY b, x), c3 AS (SELECT c, b, x, count(*) AS n FROM t WHERE i > 2 GROUP BY c, b, x),
total AS (SELECT count(*) AS n FROM t),
v AS (SELECT t.doc_id, i, c1.n AS n1, c2.n AS n2, c3.n AS n3, p1.n AS m1, p2.n AS m2 FROM t JOIN c1 ON c1.x = t.x LEFT JOIN c2 ON c2.b = t.b AND c2.x = t.x LEFT JOIN c3 ON c3.c = t.c AND c3.b = t.b AND c3.x = t.x LEFT JOIN c1 p1 ON p1.x = t.b LEFT JOIN c2 p2 ON p2.b = t.c AND p2.x = t.b),
s AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN n3 >= 2 THEN ln(n3 / m2) ELSE CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END + CASE WHEN n2 >= 2 THEN ln(n2 / m1) ELSE CASE WHEN i > 1 THEN ln(0.4) ELSE 0 END + ln(n1 / total.n) END END) AS v FROM v, total GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(v, 0), 6) AS log_score, round(v / n_words, 6) AS word_log_score FROM w LEFT JOIN s USING (doc_id)
""",
    "op5_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256 FROM t JOIN g USING (x)
""",
    "op6_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(a), 10) AS k, array_to_string(a[i:i + least(len(a), 10) - 1], ' ') AS g FROM b, unnest(range(1, len(a) - least(len(a), 10) + 2)) AS u(i) WHERE len(a) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(a[i:i + k - 1], ' ') AS g FROM d, ks, unnest(range(1, len(a) - k + 2)) AS u(i) WHERE len(a) >= k),
occ AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_line_dedup": f"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT doc_id, i, line, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), {_AZ}) AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(often.key)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often USING (key) GROUP BY doc_id
""",
    "op10_mixing": """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::DOUBLE AS w, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS no FROM s0),
s2 AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(no % 3) + 1] AS wt, w * 3 AS lim, sum(w) OVER () AS total FROM s1),
s3 AS (SELECT *, lim / wt AS ratio, (total - coalesce(sum(lim) OVER b, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS level FROM s2
       WINDOW b AS (ORDER BY lim / wt, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, max(CASE WHEN ratio >= level THEN level END) OVER () AS water FROM s3),
s AS (SELECT source, no, w, n, total, coalesce(least(lim, water * wt), 0) AS target, ceil(n / 20000.0)::BIGINT AS shards, floor(total / 16 + 0.5)::BIGINT AS seats FROM s4),
a1 AS (SELECT no, target, seats, total, CASE WHEN total > 0 THEN floor(target * seats / sum(target) OVER () + 0.5) ELSE 0 END::BIGINT AS r, count(*) OVER () AS k, sum(target) OVER () AS whole FROM s),
a2 AS (SELECT *, (seats - sum(r) OVER ())::BIGINT AS miss FROM a1),
a3 AS (SELECT *, unnest(range(1, (floor(target * (abs(miss) + k) / whole)::BIGINT + 2))) AS j FROM a2 WHERE miss <> 0 AND whole > 0),
a4 AS (SELECT no, miss, row_number() OVER (ORDER BY CASE WHEN miss > 0 THEN -(target / (r + j - 0.5)) ELSE target / (r - j + 0.5) END, CASE WHEN miss > 0 THEN no ELSE -no END, j) AS nth FROM a3 WHERE miss > 0 OR j <= r),
a5 AS (SELECT no, sum(sign(miss))::BIGINT AS c FROM a4 WHERE nth <= abs(miss) GROUP BY no),
q AS (SELECT a2.no, r + coalesce(c, 0) AS seats FROM a2 LEFT JOIN a5 USING (no)),
p1 AS (SELECT d.doc_id, d.size, s.no, md5(concat_ws('|', '17', d.doc_id::VARCHAR)) AS key, s.shards FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM p1),
h AS (SELECT no, shard, sum(size)::BIGINT AS words FROM p GROUP BY no, shard),
b1 AS (SELECT h.no, shard, words, seats, sum(words) OVER (PARTITION BY h.no)::DOUBLE AS whole, count(*) OVER (PARTITION BY h.no) AS k FROM h JOIN q USING (no)),
b2 AS (SELECT *, CASE WHEN whole > 0 THEN floor(words::DOUBLE * seats / whole + 0.5) ELSE 0 END::BIGINT AS r FROM b1),
b3 AS (SELECT *, CASE WHEN whole > 0 THEN seats - sum(r) OVER (PARTITION BY no) ELSE 0 END::BIGINT AS miss FROM b2),
b4 AS (SELECT *, unnest(range(1, (floor(words::DOUBLE * (abs(miss) + k) / whole)::BIGINT + 2))) AS j FROM b3 WHERE miss <> 0),
b5 AS (SELECT no, shard, miss, row_number() OVER (PARTITION BY no ORDER BY CASE WHEN miss > 0 THEN -(words / (r + j - 0.5)) ELSE words / (r - j + 0.5) END, CASE WHEN miss > 0 THEN shard ELSE -shard END, j) AS nth FROM b4 WHERE miss > 0 OR j <= r),
b6 AS (SELECT no, shard, sum(sign(miss))::BIGINT AS c FROM b5 WHERE nth <= abs(miss) GROUP BY no, shard),
g1 AS (SELECT b3.no, b3.shard, words, r + coalesce(c, 0) AS quota, ceil(words / 16.0)::BIGINT AS blocks FROM b3 LEFT JOIN b6 ON b3.no = b6.no AND b3.shard = b6.shard),
g AS (SELECT no, shard, blocks, least(quota, 3 * blocks) // blocks AS times, least(quota, 3 * blocks) % blocks AS more, ('0x' || substr(md5(concat_ws('|', '17', 'run', no::VARCHAR, shard::VARCHAR)), 1, 8))::BIGINT % blocks AS f FROM g1 WHERE blocks > 0),
o AS (SELECT p.*, sum(size) OVER (PARTITION BY no, shard ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS e FROM p)
SELECT o.doc_id, o.size, s.w::BIGINT AS source_size, s.target,
  coalesce(CASE WHEN o.size > 0 THEN times * o.size + CASE WHEN more > 0 THEN greatest(0, least(e, (f + more) * 16) - greatest(e - o.size, f * 16)) + greatest(0, least(e, (f + more - blocks) * 16) - (e - o.size)) ELSE 0 END ELSE 0 END, 0)::BIGINT AS taken
FROM o JOIN s USING (no) LEFT JOIN g ON g.no = o.no AND g.shard = o.shard
""",
    "op12_source_divergence": f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS a FROM documents),
t AS (SELECT lang, source, id, unnest(a) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS w FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, (1 + (1000000000 * (coalesce(n, 0) + 5)) // (w + 5 * v))::BIGINT AS p FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n, sum(sum(n)) OVER (PARTITION BY lang) AS w FROM c GROUP BY lang, term),
q AS (SELECT l.lang, term, (1 + (1000000000 * (n + 5)) // (w::HUGEINT + 5 * v))::BIGINT AS q FROM l JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM s WHERE part = 'pair' OR rank <= 50
""",
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS a FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS r FROM b GROUP BY item_id, t),
size AS (SELECT count(*) FILTER (len(a) > 0) AS n, sum(len(a))::BIGINT AS l FROM d),
f AS (SELECT doc_id, n_doc, t, count(*) AS tf FROM (SELECT doc_id, len(a) AS n_doc, unnest(a) AS t FROM d) GROUP BY doc_id, n_doc, t),
w AS (SELECT t, floor(1000 * ln((2 * size.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, size GROUP BY t, size.n),
s AS (SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n_doc * n) // l))))::BIGINT AS score FROM q JOIN w USING (t) JOIN f USING (t), size GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
""",
}
