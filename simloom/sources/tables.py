"""The tables in the roles that the queries give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions.vector import vector


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, side: str | None = None) -> DataFrame:
    """Segments as ``(idx, task, grp, v)``: ego rows are the even ones, tele rows the odd ones."""
    rows = table(spark, sf_dir, "embeddings")
    if side:
        rows = rows.where(F.col("vec_id") % 2 == (0 if side == "ego" else 1))
    return rows.select(F.col("vec_id").alias("idx"), F.col("label").cast("long").alias("task"), (F.col("vec_id") % 7).alias("grp"), vector("embedding").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as ``(episode, task_index, frame_index, value, event_id)``: a user's events in the order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), F.col("event_type").alias("task_index"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"), "value", "event_id")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectory frames as ``(seg, fr, a, b, c, d)``: an order's lines."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seg"), (F.row_number().over(order) - 1).cast("long").alias("fr"), *(F.col(c).cast("double").alias(n) for c, n in (("l_quantity", "a"), ("l_extendedprice", "b"), ("l_discount", "c"), ("l_tax", "d"))))
