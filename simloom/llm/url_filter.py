"""URL filters: explicit rules, and association rules that FP-growth mines from labelled URLs.

A URL's tokens are its top-level domain, registered and full host, host labels, path segments by
depth, file suffix and query keys; numbers are written ``#``. FP-growth mines token sets together
with the label; rules with enough support and confidence stay, and of those the ones that no
shorter rule with at least the same confidence makes superfluous. They match by an inverted index
from token to rule: a rule fires when all its tokens were met.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: The rules of the query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SUPPORT, CONFIDENCE = 0.01, 0.9
#: Most entries of the inverted index, and most token sets with a mined verdict, that are broadcast: about 100 MB.
BROADCAST_ROWS = 1_000_000


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_AZ), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url):
    """Sorted distinct tokens of a URL; a null URL has none."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "#"), "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    tokens = F.concat(
        F.array(F.concat(F.lit("tld="), F.element_at(labels, -1)), F.concat(F.lit("site="), F.substring_index(host, ".", -2)), F.concat(F.lit("host="), host)),
        F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("label="), x)),
        F.transform(segments, lambda x, k: F.concat(F.lit("path"), k.cast("string"), F.lit("="), x)),
        F.transform(F.filter(F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), lambda x: x != ""), lambda x: F.concat(F.lit("suffix="), F.lower(x))),
        F.transform(query, lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1))),
    )
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens)))


def explicit_rules(urls: DataFrame, rules: tuple) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) with ``rule`` and ``rule_verdict`` of the longest rule that fits.

    ``rules`` are (host, path, verdict), a list that the caller states and the plan holds. A rule fits
    its host and all its subdomains, if the path starts with the rule's. Each row looks up the suffixes
    of its own host; nothing is joined.
    """
    by_host: dict[str, list] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append(F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(path).alias("rule_path"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    known = F.create_map(*(x for host, own in by_host.items() for x in (F.lit(host), F.array(*own))))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = F.flatten(F.filter(F.transform(suffixes, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(own, lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return urls.withColumn("best", best).withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.verdict")}).drop("best")


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Association rules ``(rule_id, tokens, verdict, confidence, support)`` from ``(tokens, label)``.

    Rows without tokens or label are not used. Nothing to learn from: no rules. There are at most as
    many rules as frequent token sets, which the support bounds.
    """
    spark = labelled.sparkSession
    items = labelled.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select(F.concat("tokens", F.array(F.concat(F.lit("\x00"), F.col("label")))).alias("items"))
    items = written(items, "url-items")
    if not items.limit(1).count():
        return spark.createDataFrame([], "rule_id long, tokens array<string>, verdict string, confidence double, support double")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
    found = found.where(F.startswith(F.col("consequent")[0], F.lit("\x00")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("\x00"))))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 2, 1 << 20).alias("verdict"), "confidence", "support")
    found = written(found.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "url-rules")
    # a rule with one token less and at least the confidence makes a rule superfluous
    less = found.select("rule_id", "verdict", F.col("confidence").alias("own"), F.explode(F.transform("tokens", lambda x: F.array_remove("tokens", x))).alias("tokens")).join(found.select("tokens", "verdict", "confidence"), ["tokens", "verdict"]).where("confidence >= own").select("rule_id")
    return found.join(less, "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def mined_verdicts(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(key, mined)`` of the strongest rule that fires for each of ``(key, tokens)``, by an inverted index.

    The index has an entry for each token of each rule. Rules are at most as many as the support
    lets be; the index is broadcast up to ``BROADCAST_ROWS`` entries.
    """
    index = rules.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("needed"), "verdict", "confidence", "support")
    met = token_sets.select("key", F.explode("tokens").alias("token")).join(_small(index), "token")
    fired = met.groupBy("key", "rule_id", "needed", "verdict", "confidence", "support").agg(F.count("*").alias("n")).where("n = needed")
    return fired.groupBy("key").agg(F.max(F.struct("confidence", "support", "needed", "verdict")).alias("best")).select("key", F.col("best.verdict").alias("mined"))


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = "allow") -> DataFrame:
    """Verdict on each url of ``pages``, which needs ``page_id`` and ``url``; other columns are not read.

    A URL that an explicit rule fits has that rule's verdict; of several the longest wins. Others
    have the verdict of the strongest rule that fires of those mined from ``labels`` ``(url, label)``
    (confidence, then support, then number of tokens, then verdict), else ``default``. Host: after the
    first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#``
    or the end; a null url, or one without ``://``, has neither and fits no explicit rule. Rows whose
    label or url is null teach nothing; repeated rows count each. Returns ``page_id``, ``host``,
    ``path``, ``rule`` and ``verdict``, one row per row. No rows: no rows.
    """
    spark = pages.sparkSession
    url = F.col("url")
    ruled = explicit_rules(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_tokens(url).alias("tokens")), rules)
    ruled = ruled.withColumn("key", F.md5(F.array_join("tokens", "\x01")))
    labelled = labels.select(url_tokens(url).alias("tokens"), "label") if labels is not None else spark.createDataFrame([], "tokens array<string>, label string")
    mined = written(mine_rules(labelled, support, confidence), "url-mined")
    sets = ruled.where(F.col("rule").isNull()).groupBy("key").agg(F.first("tokens").alias("tokens"))
    verdicts = written(mined_verdicts(sets, mined), "url-verdicts")
    deleted(mined)
    out = ruled.drop("tokens").join(_small(verdicts), "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "mined", F.lit(default)).alias("verdict"))
