"""Result sinks and readers, MessagePack, streamed tars, and operators over many blocks and ranges, on small made-up data."""

import io
import itertools
import json
import hashlib
import math
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import layers
from simloom.functions.msgpack import unpack
from simloom.operators import pairing, segments
from simloom.operators import similarity as sim
from simloom.operators.trajectory import compare
from simloom.sources import recordings, results


def test_matrix_and_metadata(spark, tmp_path):
    rows = np.random.default_rng(1).normal(size=(25, 3)).astype(np.float32)
    np.save(tmp_path / "e.npy", rows)
    (tmp_path / "m.json").write_text(json.dumps([{"task": f"t{k}", "episode": k} for k in range(25)]))
    got = {r["idx"]: r for r in results.read_embeddings(spark, str(tmp_path / "e.npy"), str(tmp_path / "m.json")).collect()}
    assert len(got) == 25 and all(np.allclose(got[k]["v"], rows[k]) and got[k]["task"] == f"t{k}" for k in range(25))
    assert {r["idx"] for r in results.read_matrix(spark, f"file://{tmp_path}/e.npy", 4).collect()} == set(range(25))
    (tmp_path / "m.json").write_text("[{}]".replace("{}", '{"task": "a"}'))
    with pytest.raises(ValueError):
        results.read_embeddings(spark, str(tmp_path / "e.npy"), str(tmp_path / "m.json"))
    np.save(tmp_path / "f.npy", np.asfortranarray(rows))
    with pytest.raises(ValueError):
        results.read_matrix(spark, str(tmp_path / "f.npy"))
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert results.read_matrix(spark, str(tmp_path / "none.npy")).collect() == []


def test_batches_as_json(spark, tmp_path):
    batches = spark.createDataFrame([(b, s, 10 * b + s, 100 * b + s) for b in range(3) for s in range(2)], "batch_id int, slot int, ego_idx long, tele_idx long")
    matrix = spark.createDataFrame([(b, i, j, float(b + i - j)) for b in range(3) for i in range(2) for j in range(2)], "batch_id int, i int, j int, sim double")
    records = results.batch_records(batches, matrix)
    first, second = f"file://{tmp_path}/own", str(tmp_path / "other")
    results.write_batches(records.where("batch_id < 2"), first)
    results.write_batches(records.where("batch_id = 2"), second, "x")
    assert results.listed_batches(first) == [0, 1] and results.listed_batches(str(tmp_path / "nowhere")) == []
    one = results.read_batch(spark, 1, first, second).first()
    assert one["ego"] == [10, 11] and one["sim_matrix"] == [[1.0, 0.0], [2.0, 1.0]] and one["diag_mean"] == 1.0
    assert results.read_batch(spark, 2, first, second).first()["tele"] == [200, 201]
    with pytest.raises(FileNotFoundError):
        results.read_batch(spark, 9, first, second)
    assert results.read_summary(spark, first).first()["n_batches"] == 2 and results.read_summary(spark, second) is None
    (tmp_path / "other" / "batches_info.json").write_text('{"n_batches": 7}')
    assert results.read_summary(spark, second).first()["n_batches"] == 7
    empty = results.batches_summary(records.limit(0)).first()
    assert (empty["n_batches"], empty["ego_used"], empty["mean"], empty["p50"]) == (0, 0, 0.0, 0.0)


def test_caches_and_json(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert results.cached(spark, str(tmp_path / "c"), make).count() == 3
    assert len(made) == 1
    results.write_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    vectors = spark.createDataFrame([(k, 0, 0, [float(k), 1.0]) for k in range(4)], "idx long, task long, grp long, v array<double>")
    assert not sim.write_cross(vectors, vectors, str(tmp_path / "x"), 16) and sim.write_cross(vectors, vectors, str(tmp_path / "x"), 17)
    assert spark.read.parquet(str(tmp_path / "x")).where("i = 2 AND j = 3").first()["sim"] == 7.0
    recordings.append_new(spark.range(2).select(F.col("id").alias("idx"), F.lit("x").alias("cam_images")), str(tmp_path / "a"), "idx", ("cam_images",))
    assert spark.read.parquet(str(tmp_path / "a")).columns == ["idx"]


def test_messagepack():
    whole = b"\x86" + b"\xa1a\x01" + b"\xa1b\xff" + b"\xa1c\xcb" + struct.pack(">d", 2.5) + b"\xa1d\x93\xc0\xc2\xc3" + b"\xa1e\xd9\x02\xc3\xa9" + b"\xa1f\xcd\x01\x00"
    assert unpack(whole) == {"a": 1, "b": -1, "c": 2.5, "d": [None, False, True], "e": "é", "f": 256}
    assert unpack(b"\xc4\x02\x00\x01") == b"\x00\x01" and unpack(b"\xd3" + struct.pack(">q", -(2**40))) == -(2**40)
    assert unpack(b"\xdc\x00\x11" + bytes(range(17))) == list(range(17)) and unpack(b"\xde\x00\x01\xa1k\x90") == {"k": []}
    for bad in (b"", b"\xa5ab", b"\xcd\x01", b"\x01\x02", b"\xc1", b"\x92\x01"):
        with pytest.raises(ValueError):
            unpack(bad)


def tar(path, members, cut=None):
    with tarfile.open(path, "w") as out:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    if cut:
        path.write_bytes(path.read_bytes()[:cut])


def test_streamed_tars(spark, tmp_path):
    folder = tmp_path / "webdataset" / "fold" / "day1"
    folder.mkdir(parents=True)
    meta = b"\x83\xaatask_index\x91\x05\xa4task\xa4fold\xa1s\xcb" + struct.pack(">d", 0.5)
    names = [x for k in range(6) for x in ((f"ep000001_fr{k:06d}.cam_high.jpg", bytes(3000)), (f"ep000001_fr{k:06d}.meta.msgpack", meta))]
    tar(folder / "a.tar", [*names, ("ep000001_fr000009.cam_high.jpg", b"x")])
    tar(folder / "cut.tar", names, 9000)
    (tmp_path / "plain").mkdir()
    tar(tmp_path / "plain" / "b.tar", names)
    members = recordings.tar_members(spark, str(folder), batch_bytes=5000)
    whole = members.where("path LIKE '%/a.tar'")
    assert whole.count() == 13 and 0 < members.where("path LIKE '%/cut.tar'").count() < 12
    got = recordings.frame_metadata(whole, "task_index long, task string, s double").collect()
    assert len(got) == 6 and {(r["episode"], r["task_index"], r["task"], r["s"]) for r in got} == {(1, 5, "fold", 0.5)}
    groups = recordings.grouped_members(whole).collect()
    assert len(groups) == 6 and all(len(r["members"]) == 2 for r in groups)
    found = recordings.webdataset_tars(spark, str(tmp_path)).collect()
    assert [(r["task_name"], r["dataset_dir"], r["path"][-7:]) for r in found] == [("fold", "day1", "1/a.tar"), ("fold", "day1", "cut.tar")]


def test_fetched_tars(tmp_path):
    source = tmp_path / "far.tar"
    tar(source, [("a", bytes(5000))])
    tries = []

    def flaky(uri, path):
        tries.append(uri)
        if len(tries) < 3:
            open(path, "wb").close()
            raise OSError("not now")
        with open(path, "wb") as f:
            f.write(source.read_bytes())

    path = recordings.fetched("tos://bucket/x/far.tar", str(tmp_path / "cache"), wait=0, copy=flaky)
    assert path.endswith("bucket_x_far.tar") and len(tries) == 3
    assert recordings.fetched("tos://bucket/x/far.tar", str(tmp_path / "cache"), copy=flaky) == path and len(tries) == 3
    with open(path, "wb") as f:
        f.write(b"x" * 2000)
    assert recordings.fetched("tos://bucket/x/far.tar", str(tmp_path / "cache"), copy=flaky) == path and len(tries) == 4
    assert tarfile.open(recordings.fetched(f"file://{source}", str(tmp_path / "cache"))).getnames() == ["a"]
    with pytest.raises(OSError):
        recordings.fetched(f"{tmp_path}/nowhere.tar", str(tmp_path / "cache"), wait=0)


def test_encoders(spark):
    class Toy:
        def encode(self, items):
            return [[3.0, 4.0] for _ in items]

    class Odd:
        def encode(self, items):
            return [[1.0], [math.nan]]

    rows = spark.createDataFrame([(1, "a"), (2, None)], "idx long, task string")
    assert [r["vector"] for r in recordings.encoded(rows, "task", Toy, normalise=True).orderBy("idx").collect()] == [[0.6, 0.8], None]
    assert recordings.preflight(Toy, ["a", "b"]) == 2
    for items in (["a", "b"], ["a"]):
        with pytest.raises(ValueError):
            recordings.preflight(Odd, items)


def test_layers(spark):
    rows = spark.createDataFrame([([1.0, -2.0, 0.5, 3.0],), ([0.0, 0.0, 0.0, 0.0],)], "v array<double>")
    v = F.col("v")
    got = rows.select(*(layers.activation(v, n).alias(n) for n in ("relu", "gelu", "glu")), layers.layer_norm(v).alias("norm"), layers.linear(v, [[1.0, 1.0, 1.0, 1.0], [0.0, 2.0, 0.0, 0.0]], [1.0, 0.5]).alias("lin")).first()
    x = np.array([1.0, -2.0, 0.5, 3.0])
    assert got["relu"] == [1.0, 0.0, 0.5, 3.0] and np.allclose(got["gelu"], [y * 0.5 * (1 + math.erf(y / math.sqrt(2))) for y in x])
    assert np.allclose(got["glu"], [1 / (1 + math.exp(-0.5)), -2 / (1 + math.exp(-3.0))]) and got["lin"] == [3.5, -3.5]
    assert np.allclose(got["norm"], (x - x.mean()) / np.sqrt(x.var() + 1e-5))
    with pytest.raises(ValueError):
        layers.activation(v, "other")


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(7)
    ego, tele = (np.round(rng.normal(size=(n, 3)), 2) for n in (53, 38))
    schema = "idx long, task long, grp long, cluster int, v array<double>"
    return (ego, tele, *(spark.createDataFrame([(k, k % 4, k % 3, k * k % 3, x.tolist()) for k, x in enumerate(rows)], schema) for rows in (ego, tele)))


@pytest.fixture(params=[(7, 1), (7, 1 << 20), (2048, 1 << 26)])
def cut(request, monkeypatch):
    """Blocks of a few rows, pieces of a few rows in one block, and all in one."""
    monkeypatch.setattr(sim, "TILE", request.param[0])
    monkeypatch.setattr(sim, "BLOCK_BYTES", request.param[1])


def test_tiles(spark, sides, cut):
    ego, tele, e, t = sides
    s = np.round(ego @ tele.T, 9)
    rows = sim.topk(e, t, 4).collect()
    assert sorted((r["query_idx"], r["rank"], r["match_idx"]) for r in rows) == [(i, k + 1, j) for i in range(53) for k, j in enumerate(sorted(range(38), key=lambda j: (-s[i, j], j))[:4])]
    own = np.round(ego @ ego.T, 9)
    upper = own[np.triu_indices(53, 1)]
    found = sim.self_stats(e).first()
    assert found["n_pairs"] == len(upper) and (found["max_sim"], found["min_sim"], found["std_sim"]) == pytest.approx((upper.max(), upper.min(), upper.std()), abs=1e-6)
    pairs = sorted((-own[i, j], i, j) for i, j in itertools.combinations(range(53), 2) if i % 3 != j % 3)[:12]
    assert [(r["i"], r["j"]) for r in sim.best_pairs(e, e, 12, within=True).collect()] == [(i, j) for _, i, j in pairs]
    flat = [(i, j) for i in range(53) for j in range(38) if s[i, j] >= 1]
    assert [(r["i"], r["j"]) for r in sim.first_pairs(e, t, 9, 1.0).collect()] == flat[:9]
    assert {(r["i"], r["j"]): r["sim"] for r in sim.cross_matrix(e, t).collect()} == {(i, j): pytest.approx(s[i, j]) for i in range(53) for j in range(38)}
    bins = np.minimum(np.floor((s - s.min()) / ((s.max() - s.min()) / 20)), 19).astype(int)
    assert {r["bin"]: r["n"] for r in sim.pair_histogram(e, t, 20).collect()} == dict(zip(*(x.tolist() for x in np.unique(bins, return_counts=True))))
    bands = {(r["band"], r["colour"]): r["n"] for r in sim.band_counts(e, t, [("HIGH", 1.0), ("BAD", None)], [("green", 2.0), ("red", None)], 1.0, -1.0).collect()}
    assert bands == {k: n for k, n in {("HIGH", "green"): (s > 2).sum(), ("HIGH", "red"): ((s >= 1) & (s <= 2)).sum(), ("BAD", "red"): (s <= -1).sum()}.items() if n}
    clusters = {r["cluster"]: (r["n_pairs"], r["max_sim"]) for r in sim.cluster_stats(e, t).collect()}
    a, b = (np.array([k * k % 3 for k in range(n)]) for n in (53, 38))
    assert clusters == {c: (int((a == c).sum() * (b == c).sum()), pytest.approx(s[np.ix_(a == c, b == c)].max(), abs=1e-6)) for c in (0, 1)}


def test_tiles_of_nothing(spark, sides):
    _, _, e, t = sides
    none = e.limit(0)
    assert sim.topk(none, t, 3).collect() == sim.topk(e, none, 3).collect() == [] and sim.pair_histogram(none, t, 5).collect() == []
    assert sim.cluster_stats(none, t).collect() == []


def test_metadata_match_of_null_keys(spark):
    schema = "k1 string, k2 long"
    meta = spark.createDataFrame([(4, "a", 1), (2, None, 1), (9, "b", None), (7, None, None)], f"idx long, {schema}")
    asked = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, None, None), (4, "a", 2), (5, None, 1), (6, "a", 1)], f"qid long, {schema}")
    got = {r["qid"]: r["idx"] for r in sim.metadata_match(asked, meta, ["k1", "k2"]).collect()}
    assert got == {1: 2, 2: 9, 5: 2, 6: 2}


def test_running_sums_of_ranges(spark):
    rng = np.random.default_rng(4)
    keys = [1, 1 << 40, *rng.integers(0, 50, 300).tolist()]
    rows = spark.createDataFrame([(k, i, i % 5) for i, k in enumerate(keys)], "key long, tie long, size long")
    order = sorted(range(len(keys)), key=lambda i: (keys[i], i))
    for block in (10, 100_000):
        places = {r["tie"]: r["pos"] for r in segments.numbered(rows, "key", "pos", "tie", block=block).collect()}
        assert [places[i] for i in order] == list(range(len(keys)))
    sums = {r["tie"]: r["held"] for r in segments.running(rows, F.col("size"), "held", -F.col("key"), "tie", block=25).collect()}
    back = sorted(range(len(keys)), key=lambda i: (-keys[i], i))
    assert [sums[i] for i in back] == np.cumsum([i % 5 for i in back]).tolist()
    assert segments.numbered(rows.limit(0), "key", "pos", "tie").collect() == []


def test_matched_batches(spark, sides):
    _, _, e, t = sides
    tasks = spark.createDataFrame([(0, 1), (2, 2), (99, 1)], "ego_task long, tele_task long")
    rows = pairing.matched_batch(tasks, e, t, 10).collect()
    by = {(r["side"], r["slot"]): r for r in rows}
    assert len(rows) == len(by) == 10 and all((by["ego", k]["task"], by["tele", k]["task"]) in {(0, 1), (2, 2)} for k in range(5))
    assert rows == pairing.matched_batch(tasks, e, t, 10).collect()
    many = pairing.matched_batch(tasks, e, t, 120).where("side = 'ego'").groupBy("task").count().collect()
    assert all(15 < r["count"] < 45 for r in many)  # drawn, not taken in turn
    with pytest.raises(ValueError, match="no pair"):
        pairing.matched_batch(tasks.where("ego_task = 99"), e, t, 10)
    pairs = spark.createDataFrame([(k, k, 0.5, int(k < 3)) for k in range(20)], "i long, j long, sim double, label int")
    assert pairing.balanced_pairs(pairs, 1.5).groupBy("label").count().orderBy("label").collect() == [(0, 4), (1, 3)]


def test_compare_of_missing_sides(spark):
    one = [[1.0, 2.0]]
    rows = [(1, one, None), (2, [], one), (3, [[math.nan, 1.0]], one), (4, one * 3, one * 2), (5, None, None)]
    pairs = spark.createDataFrame(rows, "k int, states_a array<array<double>>, states_b array<array<double>>")
    got = {r["k"]: r for r in compare(pairs, [1.0, 1.0]).collect()}
    for k in (1, 2, 5):
        assert tuple(got[k][c] for c in ("len_a", "len_b", "dim", "dtw_path")) == (0, 0, 0, 0) and got[k]["interp_distance"] == got[k]["dtw_distance"] == math.inf
    assert got[3]["interp_distance"] == got[3]["dtw_distance"] == round(math.sqrt(2), 6)
    assert (got[4]["len_a"], got[4]["len_b"], got[4]["dim"], got[4]["dtw_distance"]) == (3, 2, 2, 0.0)


def test_balanced_pairs_are_those_of_least_hash(spark):
    pairs = spark.createDataFrame([(k, k % 7, 0.5, int(k < 300)) for k in range(4000)], "i long, j long, sim double, label int")
    got = pairing.balanced_pairs(pairs, 1.5).where("label = 0").select("i", "j").collect()
    order = sorted((hashlib.md5(f"7|{k}|{k % 7}".encode()).hexdigest(), k, k % 7) for k in range(300, 4000))
    assert sorted(map(tuple, got)) == sorted(x[1:] for x in order[:450])
    assert pairing.balanced_pairs(pairs, 99.0).count() == 4000
    sets = pairing.labelled_sets(pairs, 5, 9).collect()
    assert sorted((r["nth"], r["i"]) for r in sets if r["label"] == 0) == [(n, x[1]) for n, x in enumerate(order[:9], 1)]
    assert sum(r["label"] for r in sets) == 5


def test_numbers_beyond_doubles(spark):
    """Ids that are the same as doubles keep their order."""
    ids = [2**60 + k for k in range(300)] + [-(2**60) - k for k in range(300)]
    rows = spark.createDataFrame([(i,) for i in ids], "idx long").repartition(5)
    for block in (50, 65_536):
        found = segments.numbered(rows, "idx", block=block).orderBy("pos").collect()
        assert [(r["idx"], r["pos"]) for r in found] == [(i, k) for k, i in enumerate(sorted(ids))]


def test_states_of_another_width(spark):
    for states in ([[1.0, 2.0, 3.0], [1.0]], [[1.0, 2.0], None]):
        pairs = spark.createDataFrame([(1, states, [[1.0, 2.0]])], "k int, states_a array<array<double>>, states_b array<array<double>>")
        with pytest.raises(Exception, match="one for each weight"):
            compare(pairs, [1.0, 1.0]).collect()
