"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: the whole of all words is shared by weight; a target stops at ``most_repeats`` times
   its source's words, and the excess is shared again by weight among the others. The fixed point
   is one water level, found by sorting sources by limit over weight.
2. The words are cut to blocks of ``block_words``. Sainte-Laguë gives the blocks to sources by the
   highest quotients ``target / (seats + 1/2)``, and a source's blocks to its shards in the same
   way by their words. Shards hold about ``shard_docs`` documents, so that a large source is many.
3. In a shard, documents stand in a seeded order, and the running sum of their words says which
   blocks each covers. All blocks are taken as often as the quota holds them whole; what is left is
   a run of blocks from a seeded one on.

Only DataFrame functions are used; the text itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)


def _apportion(parts: DataFrame, group: str) -> DataFrame:
    """Seats of each part: rows ``(group, part, weight, seats)``, ``seats`` of the whole group, get ``quota``.

    Rounded shares come near: they miss the seats of a group by at most half its parts. The seats
    that are missing or too many go by quotient; for each part only so many quotients are listed
    as can matter, about twice the number of parts in all.
    """
    all_of = Window.partitionBy(group)
    base = parts.withColumn("whole", F.sum("weight").over(all_of)).withColumn("parts", F.count("*").over(all_of))
    share = F.when(F.col("whole") > 0, F.floor(F.col("weight") * F.col("seats") / F.col("whole") + 0.5)).otherwise(F.lit(0)).cast("long")
    base = base.withColumn("rounded", share)
    base = base.withColumn("missing", F.when(F.col("whole") > 0, F.col("seats") - F.sum("rounded").over(all_of)).otherwise(F.lit(0)).cast("long"))
    few = F.floor(F.col("weight") * (F.abs("missing") + F.col("parts")) / F.col("whole")).cast("long") + 1
    listed = F.when(F.col("missing") > 0, few).when(F.col("missing") < 0, F.least(few, F.col("rounded"))).otherwise(F.lit(0).cast("long"))
    steps = base.withColumn("listed", listed).where("listed > 0").select(group, "part", "weight", "rounded", "missing", F.explode(F.sequence(F.lit(1).cast("long"), F.col("listed"))).alias("j"))
    up = F.col("missing") > 0
    quotient = F.col("weight") / F.when(up, F.col("rounded") + F.col("j") - 0.5).otherwise(F.col("rounded") - F.col("j") + 0.5)
    order = Window.partitionBy(group).orderBy(F.when(up, -quotient).otherwise(quotient), F.when(up, F.col("part")).otherwise(-F.col("part")), "j")
    changed = steps.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.abs("missing")).groupBy(group, "part").agg(F.sum(F.signum("missing").cast("long")).alias("change"))
    return base.join(changed, [group, "part"], "left").select(group, "part", (F.col("rounded") + F.coalesce("change", F.lit(0))).alias("quota"))


def _hash32(*columns):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")


def _source_targets(sources: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    s = sources.withColumn("number", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", F.col("source_size") * float(most_repeats)).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    below = Window.partitionBy(F.lit(0)).orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))))
    s = s.withColumn("water", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything))
    return s.select("source", "number", "source_size", "n_docs", "total", F.coalesce(F.least("limit", F.col("water") * F.col("weight")), F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, block_words: int = 16, shard_docs: int = 20_000, seed: int = 17) -> DataFrame:
    """How many words of each document a mix of sources at target weights takes.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are not read. A document's size
    is its number of runs of characters other than space and 0x09-0x0D (null: 0). Sources in the
    order of code points, null last, weigh ``weights`` in turn. Returns ``doc_id``, ``size``,
    ``source_size``, ``target`` (of its source) and ``taken`` (words taken, repeats counted), one
    row per row. No document gives more than ``most_repeats`` times its size, and a source's words
    come within about a block for each shard of its target. The same rows give the same mix,
    however they are partitioned; rows with one ``doc_id`` and size are interchangeable. Documents
    without words give nothing; no rows: no rows.
    """
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sizes = written(docs.select("doc_id", "source", words.alias("size")), "mix-sizes")
    sources = _source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most_repeats)
    seats = F.floor(F.col("total") / block_words + 0.5).cast("long")
    sources = written(sources.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("long")).withColumn("seats", seats), "mix-sources")
    parts = sources.select(F.lit(0).alias("group"), F.col("number").alias("part"), F.col("target").alias("weight"), "seats")
    quotas = _apportion(parts, "group").select(F.col("part").alias("number"), F.col("quota").alias("seats"))
    own = sources.select(F.col("source").alias("own"), "number", "shards")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    placed = sizes.join(own, F.col("source").eqNullSafe(F.col("own"))).select("doc_id", "size", "number", key.alias("key"), "shards")
    placed = placed.withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = placed.groupBy("number", "shard").agg(F.sum("size").alias("words"))
    given = _apportion(shards.join(quotas, "number").select("number", F.col("shard").alias("part"), F.col("words").cast("double").alias("weight"), "seats"), "number")
    blocks = F.ceil(F.col("words") / block_words).cast("long")
    plan = shards.join(given.withColumnRenamed("part", "shard"), ["number", "shard"]).withColumn("blocks", blocks)
    plan = plan.withColumn("quota", F.least(F.col("quota"), F.col("blocks") * most_repeats)).where("blocks > 0")
    plan = plan.select("number", "shard", "words", F.expr("quota DIV blocks").alias("times"), F.expr("quota % blocks").alias("more"), (_hash32(F.lit(str(seed)), F.lit("run"), F.col("number").cast("string"), F.col("shard").cast("string")) % F.col("blocks")).alias("first"), "blocks")
    order = Window.partitionBy("number", "shard").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    spans = placed.withColumn("end", F.sum("size").over(order)).withColumn("begin", F.col("end") - F.col("size"))
    out = spans.join(plan, ["number", "shard"], "left").join(sources.select("number", "source_size", "target"), "number")

    def overlap(low, high):
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), high) - F.greatest(F.col("begin"), low))

    low, high = F.col("first") * block_words, (F.col("first") + F.col("more")) * block_words
    run = overlap(low, high) + overlap(F.lit(0).cast("long"), (F.col("first") + F.col("more") - F.col("blocks")) * block_words)
    taken = F.when(F.col("size") > 0, F.col("times") * F.col("size") + F.when(F.col("more") > 0, run).otherwise(F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0).cast("long")).alias("taken"))
