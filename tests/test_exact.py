"""Values agree with their SQL to the last bit before they are rounded, and are rounded as SQL rounds them."""

import re
import struct
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from simloom.functions import layers, series, vector
from simloom.operators import pruned, similarity
from simloom.plans import heads, results, trajectory
from simloom.sources.tables import vectors

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET threads = 1")  # else sums of groups come in any order
    for name in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name,how,ratio", [("dtw", "none", 0.0), ("traj_similarity", "zscore", 0.2)])
def test_trajectory_distances(con, name, how, ratio):
    rows = con.execute(f"WITH {trajectory._TRAJ} SELECT seg, states FROM tr").fetchall()
    states, w = {seg: np.array(x) for seg, x in rows}, np.array(trajectory.WEIGHTS)
    plain = re.sub(r"round\((far|even|far / greatest\(path, 1\)), 6\)", r"\1", trajectory.SQL[name])
    wanted = {r[0]: r[1:] for r in con.execute(f"SELECT seg, dtw_distance, dtw_path{', interp_distance' if how == 'zscore' else ''} FROM ({plain})").fetchall()}
    compared = 0
    for seg in states.keys() & {s - 1 for s in states}:
        a, b = (series.normalised(states[x], how) for x in (seg, seg + 1))
        found = series.dtw(a, b, w, int(max(len(a), len(b)) * ratio))
        assert found == wanted[seg][:2]
        if how == "zscore":
            assert float(series.interpolated_distance(a, b, w)) == wanted[seg][2]
        compared += 1
    assert compared > 1000


def test_layer_norm(spark, con):
    plain = results.SQL["layer_norm"].replace("round(", "(").replace(", 9)", ")")
    wanted = dict(con.execute(f"SELECT idx, normed FROM ({plain})").fetchall())
    found = vectors(spark, str(DATA)).select("idx", layers.layer_norm(F.col("v")).alias("x")).collect()
    assert {r["idx"]: r["x"] for r in found} == wanted
    odd = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS ARRAY<DOUBLE>)), (2, array(2D, 2D)) AS t(k, v)").select("k", layers.layer_norm(F.col("v")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in odd] == [None, [0.0, 0.0]]


def bits(values):
    return [struct.pack("d", x) for x in values]


def test_rounding(spark, con):
    rng = np.random.default_rng(3)
    half = (rng.integers(-(10**9), 10**9, 3000) + 0.5) / 1e6
    x = np.concatenate([half, np.nextafter(half, np.inf), np.nextafter(half, -np.inf), rng.normal(size=3000) * 1e-6, [0.0, -0.0, np.inf, -np.inf, 1e300, -1e300]])
    con.register("numbers", pa.table({"k": np.arange(len(x)), "x": x}))
    wanted = bits(con.execute("SELECT round(x, 6) AS r FROM numbers ORDER BY k").fetchnumpy()["r"])
    assert bits(series.rounded(x, 6)) == wanted
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "k long, x double")
    assert bits(r["r"] for r in rows.select("k", vector.rounded(F.col("x"), 6).alias("r")).orderBy("k").collect()) == wanted


def test_fusion_keeps_the_sign_of_zero(spark, tmp_path):
    """A value just below zero is rounded to minus zero, as in SQL."""
    rng = np.random.default_rng(1)
    model = rng.normal(size=(20_000, 64))
    rows = model / np.linalg.norm(model, axis=1)[:, None]
    names = pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows.astype(np.float32))), "label": np.zeros(len(rows), np.int32)})
    import pyarrow.parquet as pq

    pq.write_table(names, tmp_path / "embeddings.parquet")
    got = heads.QUERIES["fusion_heads"](spark, str(tmp_path))
    values = got.select(F.explode("vector").alias("x"))
    # printed values tell the zeros apart
    assert values.where("CAST(x AS STRING) = '-0.0'").count() > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    wanted = con.execute(f"SELECT count(*) FROM (SELECT unnest(vector) AS x FROM ({heads.SQL['fusion_heads']})) WHERE x::VARCHAR = '-0.0'").fetchone()[0]
    assert values.where("CAST(x AS STRING) = '-0.0'").count() == wanted


def test_cross_matrix_rounds_as_sql(spark, con):
    """Products next to a half of the ninth digit or to zero: a matrix product adds up in another order, and halves go away from zero."""
    rng = np.random.default_rng(4)
    ego, tele = (rng.normal(size=(2, 400, 64)) / 8).astype(np.float32).astype(float)  # as the table's: products of two are exact
    halves = (rng.integers(-(10**8), 10**8, 400) + 0.5) / 1e9
    halves[:30] = 0
    ego[:, -4:], tele[:, -4:] = 1, 0
    for k in range(-4, 0):
        tele[:, k] = (halves - (ego * tele).sum(axis=1)).astype(np.float32)
    tables = [pa.table({"idx": np.arange(400), "v": list(x)}) for x in (ego, tele)]
    for name, x in zip(("rows_a", "rows_b"), tables):
        con.register(name, x)
    wanted = con.execute("SELECT a.idx, b.idx, round(list_dot_product(a.v, b.v), 9) FROM rows_a a, rows_b b ORDER BY 1, 2").fetchall()
    plain = np.round(ego @ tele.T, 9).ravel().tolist()
    assert sum(x != y for x, y in zip(bits(plain), bits(r[2] for r in wanted))) > 10  # the rows tell the two apart
    sides = [spark.createDataFrame([(k, 0, 0, v) for k, v in enumerate(x.tolist())], "idx long, task long, grp long, v array<double>") for x in (ego, tele)]
    found = sorted((r["i"], r["j"], r["sim"]) for r in similarity.cross_matrix(*sides).collect())
    assert [r[:2] for r in found] == [r[:2] for r in wanted] and bits(r[2] for r in found) == bits(r[2] for r in wanted)
    odd = np.array([[np.inf], [np.nan], [1e300], [-1.5], [0.0]])
    con.register("odd", pa.table({"k": np.arange(5), "v": list(odd)}))
    wanted = [r[0] for r in con.execute("SELECT round(list_dot_product(a.v, b.v), 9) FROM odd a, odd b ORDER BY a.k, b.k").fetchall()]
    with np.errstate(all="ignore"):
        assert np.array_equal(similarity.rounded_products(odd, odd, odd @ odd.T, 9).ravel(), wanted, equal_nan=True)


def test_threshold_pairs_round_as_sql(spark, con):
    """Products next to a half of the ninth digit, in one tile, in tiles that bounds choose and in all."""
    rng = np.random.default_rng(6)
    ego, tele = (rng.normal(size=(2, 300, 64)) / 8).astype(np.float32).astype(float)
    halves = (rng.integers(-(10**8), 10**8, 300) + 0.5) / 1e9
    ego[:, -4:], tele[:, -4:] = 1, 0
    for k in range(-4, 0):
        tele[:, k] = (halves - (ego * tele).sum(axis=1)).astype(np.float32)
    for name, x in (("near_a", ego), ("near_b", tele)):
        con.register(name, pa.table({"idx": np.arange(300), "v": list(x)}))
    wanted = con.execute("SELECT i, j, s, (s >= 0.02)::INT FROM (SELECT a.idx AS i, b.idx AS j, round(list_dot_product(a.v, b.v), 9) AS s FROM near_a a, near_b b) WHERE s >= 0.02 OR s <= -0.02 ORDER BY 1, 2").fetchall()
    plain = dict(zip(((i, j) for i in range(300) for j in range(300)), np.round(ego @ tele.T, 9).ravel().tolist()))
    assert sum(plain[r[:2]] != r[2] for r in wanted) > 10  # the rows tell the two apart
    sides = [spark.createDataFrame([(k, 0, 0, v) for k, v in enumerate(x.tolist())], "idx long, task long, grp long, v array<double>") for x in (ego, tele)]
    for found in (similarity.threshold_pairs(*sides, 0.02, -0.02), pruned.threshold_pairs(*sides, 0.02, -0.02), pruned.threshold_pairs(*sides, 0.02, -0.02, rows=40)):
        found = sorted((r["i"], r["j"], r["sim"], r["label"]) for r in found.collect())
        assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in wanted] and bits(r[2] for r in found) == bits(r[2] for r in wanted)
