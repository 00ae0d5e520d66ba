"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, written


#: Edges for each file and writing task of a round: 16 MB.
EDGES = 1_000_000


def _stars(edges: DataFrame) -> DataFrame:
    """One round. Least neighbours are dealt out apart from the edges they are joined to, so that Spark can split a hub's."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low")).hint("rebalance")
    large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()
    down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    lowest = down.groupBy("src").agg(F.min("dst").alias("low"))
    rest = down.join(lowest.hint("rebalance"), "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return rest.unionByName(lowest.select("src", F.col("low").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each end of the edges ``(src, dst)`` (both LONG, no nulls).

    ``component`` is the smallest node of the connected component. Each round is written to the
    shared folder; the rounds end when no edge changes, after about log(diameter) of them. A node
    without edges, or with edges to itself only, is not returned. No rows: no rows. The result is
    written too.
    """
    spark = edges.sparkSession
    now = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")]
    was = now.agg(*digest).first()
    while was["n"]:
        was_edges, now = now, written(_stars(now).coalesce(1 + was["n"] // EDGES), "edges")
        deleted(was_edges)
        seen = now.agg(*digest).first()
        if seen == was:
            break
        was = seen
    nodes = now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct()
    out = written(nodes.coalesce(1 + was["n"] // EDGES), "components")
    deleted(now)
    return out
