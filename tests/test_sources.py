import io
import json
import tarfile

from pyspark.sql import functions as F

from simloom.operators.segments import segments_grouped
from simloom.sources.recordings import append_new, dataset_folders, dataset_tars, encoded, frame_metadata, read_pairs, tar_members, task_dimension
from simloom.streaming.matching import match_stream


def test_tar_to_segments(spark, tmp_path):
    folder = tmp_path / "webdataset" / "fold" / "day1"
    folder.mkdir(parents=True)
    with tarfile.open(folder / "a.tar", "w") as tar:
        for frame in range(4):
            for name, data in ((f"ep000003_fr{frame:06d}.cam_high.jpg", b"x"), (f"ep000003_fr{frame:06d}.cam_left.jpg", b"y"), (f"ep000003_fr{frame:06d}.meta.json", json.dumps({"task_index": [5], "task": "fold" if frame else ""}).encode())):
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    (folder / "bad.tar").write_bytes(b"no tar")
    members = tar_members(spark, str(folder))
    assert members.where("kind = 'jpg'").count() == 4
    assert members.select("task_name", "dataset_dir").distinct().collect() == [("fold", "day1")]
    meta = frame_metadata(members, "task_index long, task string").withColumnRenamed("path", "source").withColumn("pos", F.col("frame"))
    images = members.where("kind = 'jpg'").withColumnRenamed("path", "source")
    row = segments_grouped(meta, images).first()
    assert (row["episode"], row["task_index"], row["task"], row["frame_indices"]) == (3, 5, "fold", [0, 1, 2, 3])


def test_dimension_pairs_and_append(spark, tmp_path):
    (tmp_path / "tasks.jsonl").write_text('{"task_index": 1, "task": "a"}\n{"task_index": 1, "task": "b"}\n')
    assert task_dimension(spark, str(tmp_path / "tasks.jsonl")).collect() == [(1, "b")]
    (tmp_path / "pairs.json").write_text('{"n_pairs": 1, "pairs": [{"i": 1, "j": 2}]}')
    (tmp_path / "bare.json").write_text('[{"i": 1, "j": 2}]')
    assert read_pairs(spark, str(tmp_path / "pairs.json")).collect() == read_pairs(spark, str(tmp_path / "bare.json")).collect()
    rows = spark.range(5).withColumnRenamed("id", "idx")
    append_new(rows.where("idx < 3"), str(tmp_path / "out"), "idx")
    append_new(rows, str(tmp_path / "out"), "idx")
    assert sorted(r["idx"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_encoder_and_stream(spark, tmp_path):
    class Toy:
        def encode(self, items):
            return [[float(len(x)), 1.0] for x in items]

    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "ab")], "idx long, task string")
    assert {r["idx"]: r["vector"] for r in encoded(rows, "task", Toy).collect()} == {1: [2.0, 1.0], 2: None, 3: [2.0, 1.0]}
    tele = spark.createDataFrame([(k, 0, 0, [float(k), 1.0]) for k in range(9)], "idx long, task long, grp long, v array<double>")
    tele.where("idx < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    match_stream(spark, str(tmp_path / "in"), tele, str(tmp_path / "out"), str(tmp_path / "ck"), 3).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.where("rank = 1 AND query_idx = 1").first()["match_idx"] == 8 and found.count() == 6


def test_discovery(spark, tmp_path):
    for name in ("task_b/dataset_1/meta/tasks.jsonl", "task_a/dataset_2/x", "task_a/dataset_1/x", "task_a/dataset_1_split/split1/x", "task_a/dataset_2_split/split2/d/x", "other/dataset_1/x", "task_a/readme"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")

    def names(*args):
        return [(r["task_name"], r["dataset_dir"]) for r in dataset_folders(spark, str(tmp_path), *args).collect()]

    assert names() == [("task_a", "dataset_1"), ("task_a", "dataset_2"), ("task_b", "dataset_1")]
    assert names(None, 2) == [("task_a", "dataset_1"), ("task_a", "dataset_2")]
    assert names("eval") == names("unknown") == [("task_a", "dataset_1_split")]
    assert names("train") == [("task_a", "dataset_2_split")]
    assert dataset_folders(spark, str(tmp_path), "train").first()["folder"].endswith("/task_a/dataset_2_split/split2/")
    assert dataset_folders(spark, str(tmp_path / "other")).collect() == []
    for name in ("eval/webdataset/dataset-2.tar", "eval/webdataset/dataset-1.tar", "eval/webdataset/index.json", "train/part-1/webdataset/dataset-9.tar", "train/part-0/webdataset/dataset-8.tar"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")

    def tars(*args):
        return [r["path"].rpartition("-")[2] for r in dataset_tars(spark, str(tmp_path), *args).collect()]

    assert tars("eval") == ["1.tar", "2.tar"]
    assert tars("eval", 1) == ["1.tar"]
    assert tars("train") == ["8.tar", "9.tar"]
    assert tars("none") == []


def test_cluster_falls_back(spark, monkeypatch):
    from simloom.operators import pairing

    rows = spark.createDataFrame([(i, i % 2, [float(i % 12), float(i % 5), 1.0]) for i in range(60)], "idx long, task long, v array<double>")
    assert pairing.cluster(rows, 10, 5).columns == ["idx", "task", "cluster"]
    monkeypatch.setattr(pairing, "collapsed", lambda *_: True)
    for most in (2, 256):
        found = pairing.cluster(rows, 10, 5, most_dims=most)
        assert found.columns == ["idx", "task", "cluster"]
        assert found.count() == 60 and found.select("cluster").distinct().count() > 1
