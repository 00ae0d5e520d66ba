"""Exact quantiles of columns of any size.

Spark's own exact percentile keeps every different value in one buffer. Here a mergeable sketch brackets the wanted ranks, a second pass counts
the values below and within the bracket, and the search goes on within it until few values are left to put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that are put in order in one place; accuracy of the sketch.
MOST_VALUES, ACCURACY = 50_000, 10_000


def _ranked(values: DataFrame, first: int, last: int, most: int, accuracy: int) -> tuple[float, float]:
    """The values of two neighbouring ranks, from 0, of the column ``x`` without nulls."""
    below, n = 0, None
    while True:
        n = n if n is not None else values.count()
        if n <= most:
            rows = [r["x"] for r in values.orderBy("x").collect()]
            return rows[first - below], rows[last - below]
        at, spare = (first - below) / max(1, n - 1), 2 / accuracy + 1 / n
        ends = values.agg(F.percentile_approx("x", [max(0.0, at - spare), min(1.0, at + spare)], accuracy)).first()[0]
        low, high = ends if at - spare > 0 else (None, ends[1])
        high = high if at + spare < 1 else None
        inside = F.lit(True) if low is None else F.col("x") >= low
        inside = inside if high is None else inside & (F.col("x") <= high)
        under = F.lit(False) if low is None else F.col("x") < low
        found = values.agg(F.count_if(under).alias("under"), F.count_if(inside).alias("n"), F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high")).first()
        if below + found["under"] > first or below + found["under"] + found["n"] <= last:
            accuracy = max(2, accuracy // 4)  # the sketch was further off than it says
            continue
        if found["low"] == found["high"]:
            return found["low"], found["high"]
        if found["n"] == n:
            accuracy *= 4
            continue
        values, below, n = values.where(inside), below + found["under"], found["n"]


def exact_quantiles(rows: DataFrame, column: str, cuts: list[float], most: int = MOST_VALUES, accuracy: int = ACCURACY) -> list[float | None]:
    """Quantiles of ``column`` without its nulls, interpolated between ranks; None where there are no values."""
    values = rows.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = values.count()
    if not n:
        return [None] * len(cuts)
    out = []
    for cut in cuts:
        place = cut * (n - 1)
        low, high = _ranked(values, math.floor(place), math.ceil(place), most, accuracy)
        part = place - math.floor(place)
        out.append(low * (1 - part) + high * part if part else low)
    return out


def quantile_columns(rows: DataFrame, column: str, cuts: list[float], most: int = MOST_VALUES) -> list[Column]:
    """The same as columns of an aggregate over ``rows``, which should be stored: they are read for each. Few rows need no search."""
    if rows.count() <= most:
        return [F.percentile(column, F.lit(cut)) for cut in cuts]
    return [F.lit(x).cast("double") for x in exact_quantiles(rows, column, cuts, most)]
