"""What reports show, as tables: bands, histograms, pages, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.operators.segments import numbered


def band(sim: Column, high: float = 0.85, mid: float = 0.70, low: float = 0.55) -> Column:
    return F.when(sim >= high, "HIGH").when(sim >= mid, "MID").when(sim >= low, "LOW").otherwise("BAD")


def colour(sim: Column, green: float = 0.7, yellow: float = 0.5) -> Column:
    return F.when(sim > green, "green").when(sim > yellow, "yellow").otherwise("red")


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins from the least to the largest value, which belongs to the last bin."""
    ends = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    number = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1))).cast("int")
    return values.crossJoin(F.broadcast(ends)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def paged(rows: DataFrame, per_page: int, columns: int, key: Column, *ties: str) -> DataFrame:
    """Page and grid cell of each row of a report, in the order of ``key`` and ``ties``."""
    out = numbered(rows, key, "n", *ties)
    spot = F.col("n") % per_page
    return out.withColumns({"page": F.floor(F.col("n") / per_page).cast("int"), "grid_row": F.floor(spot / columns).cast("int"), "grid_col": (spot % columns).cast("int")}).drop("n")


def heat(value: Column) -> list[Column]:
    """Red, green and blue of a similarity: white at 0, darker and greener towards 1."""
    return [(255 * (1 - value * w)).cast("int").alias(c) for c, w in (("r", 1.0), ("g", 0.5), ("b", 0.3))]
