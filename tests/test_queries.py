"""Every query of the library against its SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from simloom.functions.series import assignment
from simloom.operators.pairing import merged_batches, one_to_one_batches
from simloom.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x + 0.0:.7g}"
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return f"{x:.7g}"
    if isinstance(x, dict):
        return tuple(map(plain, x.values()))
    return tuple(map(plain, x))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    rows = found.select(*columns).collect()
    assert rows
    if name in SQL:
        cursor = tables.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})")
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)


def test_batches_are_one_to_one(spark):
    rows = QUERIES["hungarian_batches"](spark, str(DATA)).collect()
    assert len({r["ego_idx"] for r in rows}) == len({r["tele_idx"] for r in rows}) == len(rows)


def vectors_of(spark, rows, cluster=0):
    schema = "cluster int, idx long, v array<double>"
    return spark.createDataFrame([(cluster, k, [float(x) for x in v]) for k, v in enumerate(rows)], schema)


def test_a_large_cluster_is_one_assignment(spark):
    """Each tele row has one ego row like it, wherever that stands among more than 4096."""
    rng = np.random.default_rng(1)
    ego = rng.normal(size=(4200, 8))
    ego /= np.linalg.norm(ego, axis=1)[:, None]
    twins = np.arange(50) * 83
    got = one_to_one_batches(vectors_of(spark, ego), vectors_of(spark, ego[twins]), 8).collect()
    assert len(got) == 48 and {r["batch_no"] for r in got} == set(range(6))
    assert all(r["ego_idx"] == twins[r["tele_idx"]] and r["sim"] == pytest.approx(1) for r in got)


@pytest.mark.parametrize("n,m", [(29, 41), (40, 33), (24, 24), (7, 50)])
def test_batches_are_repeated_assignments(spark, n, m):
    rng = np.random.default_rng(n)
    e, t = rng.normal(size=(n, 5)), rng.normal(size=(m, 5))
    got = {(r["batch_no"], r["slot"]): (r["ego_idx"], r["tele_idx"]) for r in one_to_one_batches(vectors_of(spark, e), vectors_of(spark, t), 8).collect()}
    rows, cols, sims = np.arange(n), np.arange(m), e @ t.T
    for number in range(min(n // 8, m // 8)):
        own = sims[np.ix_(rows, cols)]
        i, j = (np.arange(len(rows)), assignment(-own)) if len(rows) <= len(cols) else (assignment(-own.T), np.arange(len(cols)))
        top = np.argsort(-own[i, j], kind="stable")[:8]
        assert [got.pop((number, slot)) for slot in range(8)] == [(rows[i[x]], cols[j[x]]) for x in top]
        rows, cols = np.delete(rows, i[top]), np.delete(cols, j[top])
    assert not got


def test_leftovers_of_clusters_are_merged(spark):
    """Of clusters with 11 x 9, 5 x 20 and 16 x 0 rows, one batch is of a cluster, two are of what is left."""
    rng, parts = np.random.default_rng(2), ([11, 5, 16], [9, 20, 0])
    sides = [[(c, k, rng.normal(size=5).tolist()) for k, c in enumerate(np.repeat([0, 1, 2], n).tolist())] for n in parts]
    ego, tele = (spark.createDataFrame(x, "cluster int, idx long, v array<double>") for x in sides)
    rows = merged_batches(ego, tele, 8).collect()
    assert sorted((-1 if r["cluster"] is None else r["cluster"], r["batch_no"], r["slot"]) for r in rows) == [(-1, b, s) for b in range(2) for s in range(8)] + [(0, 0, s) for s in range(8)]
    assert len({r["ego_idx"] for r in rows}) == len({r["tele_idx"] for r in rows}) == 24
    first = [r for r in rows if r["cluster"] is not None]
    left = [[x for x in side if x[1] not in {r[f"{name}_idx"] for r in first}] for side, name in zip(sides, ("ego", "tele"))]
    sims = np.array([x[2] for x in left[0]]) @ np.array([x[2] for x in left[1]]).T
    columns = assignment(-sims) if len(left[0]) <= len(left[1]) else assignment(-sims.T)
    best = sorted((sims[i, j] if len(left[0]) <= len(left[1]) else sims[j, i]) for i, j in enumerate(columns))[::-1][:16]
    assert sorted((r["sim"] for r in rows if r["cluster"] is None), reverse=True) == pytest.approx(best)


def test_wrapped_lines_fit(spark):
    for row in QUERIES["word_wrap"](spark, str(DATA)).limit(50).collect():
        assert all(len(x) <= 40 or " " not in x for x in row["lines"])
