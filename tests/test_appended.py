"""Appending in batches that breaks off and goes on; exact quantiles of many values."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from simloom.operators.quantiles import exact_quantiles, quantile_columns
from simloom.sources.appended import Appended, append_by_place


def test_a_run_that_breaks_off_goes_on(spark, tmp_path):
    rows = spark.range(23).select(F.col("id").alias("idx"), F.lit(b"i").alias("image"))
    done = []

    def work(part):
        done.append(sorted(r["idx"] for r in part.collect()))
        kept = part.where("idx <> 6")  # a row that can't be used is not tried again
        if len(done) == 3:
            return kept.withColumn("idx", F.when(F.col("idx") == 14, F.raise_error(F.lit("stopped"))).otherwise(F.col("idx")))
        return kept

    with pytest.raises(PySparkException):
        append_by_place(rows, str(tmp_path / "t"), 5, work, drop=("image",))
    table = Appended(spark, str(tmp_path / "t"))
    assert table.next_place() == 10 and sorted(r["idx"] for r in table.read().collect()) == [x for x in range(10) if x != 6]
    table = append_by_place(rows, str(tmp_path / "t"), 5, work, drop=("image",))
    found = table.read()
    assert sorted(r["idx"] for r in found.collect()) == [x for x in range(23) if x != 6] and found.columns == ["idx"]
    assert done[2] == done[3] == [10, 11, 12, 13, 14] and sum(map(len, done)) == 28
    assert append_by_place(rows, str(tmp_path / "t"), 5, work).next_place() == 25 and len(done) == 6
    assert table.discard_leftovers() == 1 and table.discard_leftovers() == 0
    assert found.count() == 22


def test_a_batch_counts_once(spark, tmp_path):
    table = Appended(spark, str(tmp_path / "t"))
    assert table.read() is None and table.next_place() == 0
    assert table.append("a", spark.range(3)) and not table.append("a", spark.range(9)) and table.append("b", spark.range(2))
    assert table.read().count() == 5
    assert append_by_place(spark.range(0).withColumnRenamed("id", "idx"), str(tmp_path / "u"), 5).read() is None


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed"])
def test_quantiles(spark, kind):
    rng = np.random.default_rng(2)
    x = {"spread": rng.normal(size=6001), "ties": rng.integers(0, 9, 6001).astype(float), "skewed": np.append(np.full(4000, 0.25), rng.normal(size=2001) ** 9)}[kind]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").persist()
    cuts = [0.0, 0.1, 0.25, 0.5, 0.663, 0.9, 1.0]
    assert exact_quantiles(rows, "v", cuts, most=50, accuracy=100) == pytest.approx(np.quantile(x, cuts).tolist(), abs=0, rel=1e-12)
    few, many = (rows.agg(*(c.alias(f"c{k}") for k, c in enumerate(quantile_columns(rows, "v", [0.25, 0.5], most)))).first() for most in (10_000, 100))
    assert tuple(few) == pytest.approx(tuple(many))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5, 0.9]) == [None, None]
