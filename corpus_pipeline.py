"""A training corpus out of ``documents`` in five stages, each written as Parquet and read again by the next.

Stages take ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``, and any
others that there are; where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.llm.common import bound_batches, deleted, written
from simloom.llm.decontaminate import remove_contamination
from simloom.llm.line_dedup import drop_common_lines
from simloom.llm.mixing import mix_sources
from simloom.llm.ngram_join import ngram_jaccard_join
from simloom.llm.toxicity import drop_toxic


#: Most row keys that are broadcast (16 bytes each); beyond, rows are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as it is now, null for a null text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go; a null or empty text has the score of no terms."""
    bound_batches(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten documents or more go; documents stay, a null text stays null, repeated rows count each."""
    bound_batches(spark)
    return _counted(drop_common_lines(docs))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: the smallest ``doc_id``, a null one only if there is no other.

    Rows are told apart by ``doc_id`` and text, so that different texts of one ``doc_id``, or of none,
    are documents of their own; of rows that agree in both one stays. Texts without words are linked
    with nothing: all stay.
    """
    bound_batches(spark)
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))))
    own, other = "row_key", "row_key_other"
    while any(c.lower().startswith(own) for c in docs.columns):
        own, other = f"{own}_", f"{own}__other"
    keyed = docs.withColumn(own, key)
    found = written(ngram_jaccard_join(keyed, key=own).where("root IS NOT NULL").select("doc_id", "root", "key"), "pipeline-groups")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("root", F.col("first.key").alias("stays")).hint("rebalance")
    gone = written(found.join(first, "root").where("key <> stays").select(F.col("key").alias(other)).distinct(), "pipeline-gone")
    again = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias(other))
    again = written(again.join(gone, other, "left_anti"), "pipeline-repeats")
    deleted(found)
    kept = keyed.join(_small(gone), F.col(own) == F.col(other), "left_anti")
    if again.limit(1).count():
        once = kept.join(_small(again), F.col(own) == F.col(other), "left_semi").dropDuplicates([own])
        kept = kept.join(_small(again), F.col(own) == F.col(other), "left_anti").unionByName(once)
    return kept.select(*map(_quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents stay, a null text stays null."""
    bound_batches(spark)
    return _counted(remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; a null text has none, a null source is a source of its own."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("mixing", mixing)]

#: The fitted toxicity model can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for the tables in ``sf_dir``. No documents: no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
