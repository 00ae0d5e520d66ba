"""Line deduplication against brute force: thresholds, compaction, both ways of taking common lines to the texts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from simloom.llm import line_dedup
from simloom.llm.line_dedup import HashSet, LineRuns, drop_common_lines, line_hash, line_report

SCHEMA = "doc_id long, text string, `a b` int, `a.b` int, `x``y` int, row string, hits int, batch int"


def brute(rows, least=10):
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if docs[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    rows = []
    for k in range(60):
        lines = [f"own {k}", *(rng.choice([f"line {j}", f" LINE {j}\t"]) for j in rng.sample(range(20), 4)), "", rng.choice(["Été", "x" * 5000])]
        if k < 9:
            lines.append("in nine")
        if k < 10:
            lines += ["in ten", "In Ten "]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    return [*rows, rows[0], rows[0], (None, rows[3][1]), (70, None), (71, ""), (72, "\n\n"), (73, "\r\n a"), (74, "tail\n")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "r", 4, 5) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("most", [1_000_000, 0])
@pytest.mark.parametrize("batches", [1, 7])
def test_against_brute_force(spark, rows, most, batches):
    docs, want = frame(spark, rows), brute(rows)
    got = line_report(docs, batches=batches, most_broadcast=most).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, n, d, hashlib.sha256(t.encode()).hexdigest())) for i, n, d, t in want)
    out = drop_common_lines(docs, batches=batches, most_broadcast=most)
    assert out.columns == docs.columns
    texts = {(i, t) for (i, *_, t), (_, was) in zip(want, rows) if was is not None} | {(70, None)}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == texts
    assert {(r["a b"], r["a.b"], r["x`y"], r["row"], r["hits"], r["batch"]) for r in out.collect()} == {(1, 2, 3, "r", 4, 5)}


def test_no_rows(spark):
    assert line_report(frame(spark, [])).collect() == [] and drop_common_lines(frame(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1000, 10])
def test_runs_are_disjoint_and_compacted(spark, size):
    rng, runs, docs = random.Random(3), LineRuns(spark, 60, fanout=2, bucket_lines=size), Counter()
    for _ in range(5):
        batch = Counter(rng.choices(range(60), k=50))
        docs.update(batch)
        runs.add(spark.createDataFrame([(bytearray(line_hash(b"%d" % k)), n) for k, n in batch.items()], "hash binary, n long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [bytes(r["hash"]) for run in runs.runs() for r in run.where("NOT known").collect()]
    assert len(held) == len(set(held)) == len(docs)
    new = spark.createDataFrame([(bytearray(line_hash(b"%d" % k)),) for k in (5, 999)], "hash binary")
    assert [bytes(r["hash"]) for r in runs.new_lines(new).collect()] == [line_hash(b"%d" % k) for k in (5, 999) if k not in docs]
    assert {bytes(r["hash"]): r["n"] for r in runs.common(1).collect()} == {line_hash(b"%d" % k): n for k, n in docs.items()}
    assert {bytes(r["hash"]) for r in runs.common(5).collect()} == {line_hash(b"%d" % k) for k, n in docs.items() if n >= 5}
    tables = spark.sql("SHOW TABLES").count()
    runs.close()
    assert spark.sql("SHOW TABLES").count() == tables - 2


@pytest.mark.parametrize("size", [1000, 10])
def test_joins_of_buckets_need_no_exchange(spark, size):
    runs = LineRuns(spark, 50, bucket_lines=size)
    one = spark.range(50).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"), F.lit(1).cast("long").alias("n"))
    for k in range(2):
        runs.add(one.where(F.col("n") > k - 1))
    with line_dedup._in_order(spark, runs.buckets):
        plan = runs.new_lines(spark.table(runs._table(one)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and " Sort [" not in plan
    runs.close()


def test_hash_set_with_equal_first_halves():
    a, b, c = (b"12345678" + bytes([k]) * 8 for k in (1, 2, 3))
    own = HashSet(a + b + b"87654321" + bytes(8))
    assert own.holds(a + c + b + b"00000000" * 2).tolist() == [True, False, True, False]
    assert HashSet(b"").holds(a).tolist() == [False] and own.holds(b"").tolist() == []
