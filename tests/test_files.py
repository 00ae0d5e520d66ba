"""The tar source and the files that many tasks write."""

import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from simloom.sources import matrices, tars
from simloom.sources.progress import watched
from simloom.sources.results import read_embeddings, read_matrix


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tars")
    for name in ("a", "b"):
        with tarfile.open(folder / f"{name}.tar", "w") as tar:
            for frame in range(20):
                for camera, kind, data in (("cam_high", "jpg", b"h" * 700), ("cam_left", "jpg", b"l" * 900), ("meta", "json", json.dumps({"f": frame}).encode())):
                    info = tarfile.TarInfo(f"{name}/ep000001_fr{frame:06d}.{camera}.{kind}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
    (folder / "bad.tar").write_bytes(b"no tar at all")
    return folder


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("indexed", [False, True])
def test_tar_source(spark, folder, tmp_path, indexed):
    """Whole tars or runs of members; filters on camera and kind reach the scan, others stay with Spark."""
    options = {}
    if indexed:
        tars.index_tars(spark, str(tmp_path / "index"), f"{folder}/*.tar", split_bytes=10_000)
        options["index"] = str(tmp_path / "index")
    found = tars.read_tars(spark, f"{folder}/*.tar", **options)
    if indexed:
        assert found.rdd.getNumPartitions() > 4
    rows = found.collect()
    assert len(rows) == 120 and len({(r["path"], r["key"], r["camera"]) for r in rows}) == 120
    assert {(r["camera"], r["kind"], bytes(r["content"][:1])) for r in rows} == {("cam_high", "jpg", b"h"), ("cam_left", "jpg", b"l"), ("meta", "json", b"{")}
    some = found.where("camera IN ('cam_high', 'meta') AND kind = 'jpg' AND key LIKE '%_fr00000_'")
    assert some.count() == 20 and {r["camera"] for r in some.collect()} == {"cam_high"}
    kept = plan_of(some).split("BatchScan")[0]
    assert "kind" not in kept.replace("kind#", "") or "(kind" not in kept
    keys = tars.read_tars(spark, f"{folder}/*.tar", "key string, camera string", **options)
    assert keys.columns == ["key", "camera"] and keys.where("camera = 'meta'").count() == 40


def test_filters_that_are_pushed(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    reader = tars.TarReader(StructType.fromDDL("key string, content binary"), {"path": "x"})
    left = GreaterThan(("key",), "a")
    assert list(reader.pushFilters([EqualTo(("camera",), "c"), In(("kind",), ("jpg", "png")), In(("kind",), ("png", "gif")), left])) == [left]
    assert reader.only == {"camera": {"c"}, "kind": {"png"}}
    with pytest.raises(ValueError, match="no column"):
        tars.TarReader(StructType.fromDDL("other string"), {})


def test_cached_copies(spark, folder, tmp_path):
    cache = tmp_path / "cache"
    assert tars.read_tars(spark, f"{folder}/a.tar", cache=str(cache)).count() == 60
    assert [x.endswith("a.tar") for x in os.listdir(cache)] == [True]


def test_matrix_round_trip(spark, tmp_path):
    """Rows in the order of their ids, whatever these are; metadata stands row by row beside."""
    ids = [2**60 + 5, 7, 2**60 + 6, -3, 12]
    x = np.random.default_rng(1).normal(size=(5, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), f"té {i}", None if i == 7 else i, b"img") for i, v in zip(ids, x)], "idx long, v array<double>, task string, n long, cam_images binary").repartition(3)
    matrices.write_embeddings(rows, str(tmp_path / "m.npy"), str(tmp_path / "m.json"), "cam_images")
    order = np.argsort(ids)
    assert np.array_equal(np.load(tmp_path / "m.npy"), x[order])
    assert json.loads((tmp_path / "m.json").read_text()) == [{"task": f"té {ids[k]}", "n": None if ids[k] == 7 else ids[k]} for k in order]
    back = read_embeddings(spark, str(tmp_path / "m.npy"), str(tmp_path / "m.json")).orderBy("idx").collect()
    assert [r["task"] for r in back] == [f"té {ids[k]}" for k in order]
    assert sorted(os.listdir(tmp_path)) == ["m.json", "m.npy"]


def test_matrix_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "idx long, v array<double>, task string")
    matrices.write_embeddings(rows, str(tmp_path / "m.npy"), str(tmp_path / "m.json"))
    assert np.load(tmp_path / "m.npy").shape == (0, 0) and json.loads((tmp_path / "m.json").read_text()) == []
    assert read_matrix(spark, str(tmp_path / "m.npy")).collect() == []


def test_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("idx"), F.when(F.col("id") == 33, F.array(F.raise_error(F.lit("broken")).cast("double"))).otherwise(F.array(F.lit(1.0))).alias("v"))
    fails = rows.repartition(4).select((F.col("idx") * 8 + 4).alias("place"), F.unhex(F.hex(F.col("v")[0].cast("string"))).alias("content"))
    with pytest.raises(PySparkException):
        matrices._put(fails, str(tmp_path / "x.bin"), 4 + 40 * 3, b"head")
    assert os.listdir(tmp_path) == []
    short = spark.range(3).select(F.col("id").alias("place"), F.lit(b"x").alias("content"))
    with pytest.raises(PySparkException, match="are wanted"):
        matrices._put(short, str(tmp_path / "x.bin"), 9)
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError, match="2 values"):
        matrices.write_matrix(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "idx long, v array<double>"), str(tmp_path / "y.npy"))


def test_cross_matrix(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(23, 4)), rng.normal(size=(31, 4))
    sides = [spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(x)], "idx long, v array<double>") for x in (a, b)]
    assert matrices.write_cross_matrix(*sides, str(tmp_path / "cross.npy"), rows=8)
    assert np.load(tmp_path / "cross.npy") == pytest.approx(a @ b.T, abs=1e-6)
    assert not matrices.write_cross_matrix(*sides, str(tmp_path / "none.npy"), most=100)


def test_progress(spark, folder):
    """Counts rise to all tasks; one for each tar, the broken one too. Failures come through."""
    seen = []
    rows = tars.read_tars(spark, f"{folder}/*.tar").collect
    assert len(watched(spark, rows, lambda done, all_: seen.append((done, all_)), 0.05)) == 120
    assert seen == sorted(seen) and seen[-1] == (3, 3)
    with pytest.raises(ZeroDivisionError):
        watched(spark, lambda: 1 / 0, print)
