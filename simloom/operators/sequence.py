"""Action sequences: ensembles over time, queues, losses, position codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def temporal_ensemble(chunks: DataFrame, decay: float = 0.01) -> DataFrame:
    """Weighted mean of the predictions for each step; the ``i``-th oldest weighs ``exp(-decay * i)``.

    ``chunks``: ``(episode, start, actions)``, ``actions[k]`` for the step ``start + k``.
    """
    steps = chunks.select("episode", "start", F.posexplode("actions").alias("k", "action")).withColumn("step", F.col("start") + F.col("k"))
    age = F.row_number().over(Window.partitionBy("episode", "step").orderBy("start")) - 1
    weighed = steps.withColumn("w", F.exp(-decay * age))
    return weighed.groupBy("episode", "step").agg(F.count("*").alias("n"), F.round(F.sum(F.col("action") * F.col("w")) / F.sum("w"), 6).alias("action"))


def action_queue(steps: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """The action at each step when a new chunk is asked for every ``n`` steps and used up in order."""
    asked = steps.withColumn("start", (F.floor(F.col("step") / n) * n).cast("long"))
    return asked.join(chunks, ["episode", "start"]).select("episode", "step", "start", F.get("actions", (F.col("step") % n).cast("int")).alias("action"))


def masked_l1(rows: DataFrame) -> DataFrame:
    """Mean absolute error over all cells, where padded cells count as 0: ``(target, predicted, is_pad)``."""
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("target") - F.col("predicted")) * (~F.col("is_pad")).cast("int")), 6).alias("l1"))


def kl_loss(latents: DataFrame, l1: float = 0.0, weight: float = 10.0) -> DataFrame:
    """Mean over the batch of the divergence from a unit normal, and the total loss: ``(row, mu, log_var)``."""
    one = -0.5 * (1 + F.col("log_var") - F.col("mu") * F.col("mu") - F.exp("log_var"))
    sums = latents.groupBy("row").agg(F.sum(one).alias("kl"))
    return sums.agg(F.round(F.avg("kl"), 6).alias("kl"), F.round(F.lit(l1) + weight * F.avg("kl"), 6).alias("loss"))


def sinusoid_positions(spark, positions: int, size: int) -> DataFrame:
    """Sine (even) and cosine (odd) position codes: ``(pos, dim, value)``."""
    cells = spark.range(positions).select(F.col("id").alias("pos"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("dim"))
    angle = F.col("pos") / F.pow(F.lit(10000.0), 2 * F.floor(F.col("dim") / 2) / size)
    return cells.withColumn("value", F.round(F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 9))


def sinusoid_positions_2d(spark, height: int, width: int, size: int) -> DataFrame:
    """Position codes of a grid's cells, ``size`` values for the row, then ``size`` for the column: ``(y, x, dim, value)``.

    Places count from 1 and are scaled to a full turn.
    """
    cells = spark.range(height).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    cells = cells.select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(2 * size - 1))).alias("dim"))
    own, of_row = F.col("dim") % size, F.col("dim") < size
    turn = F.when(of_row, (F.col("y") + 1) / F.lit(height + 1e-6)).otherwise((F.col("x") + 1) / F.lit(width + 1e-6)) * F.lit(2 * math.pi)
    angle = turn / F.pow(F.lit(10000.0), 2 * F.floor(own / 2) / size)
    return cells.withColumn("value", F.round(F.when(own % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)), 9))


def position_code(pos: Column, size: int) -> Column:
    """The ``size`` sines and cosines of a row's position, as an array."""
    angle = lambda k: pos / F.pow(F.lit(10000.0), 2 * F.floor(k / 2) / size)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k % 2 == 0, F.sin(angle(k))).otherwise(F.cos(angle(k))))


def position_code_2d(y: Column, x: Column, height: int, width: int, size: int) -> Column:
    """The codes of a row's cell in a grid: ``size`` values for its row, then ``size`` for its column, scaled as by ``sinusoid_positions_2d``."""

    def part(at, cells):
        turn = (at + 1) / F.lit(cells + 1e-6) * F.lit(2 * math.pi)
        angle = lambda k: turn / F.pow(F.lit(10000.0), 2 * F.floor(k / 2) / size)
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k % 2 == 0, F.sin(angle(k))).otherwise(F.cos(angle(k))))

    return F.concat(part(y, height), part(x, width))
