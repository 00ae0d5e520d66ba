"""Line deduplication with levelled sorted runs of line hashes.

``LineRuns`` holds runs ``(hash, n, known)`` sorted by hash. A new batch of lines, with the number of
its documents that have each, is merge-joined with the runs: what no run holds, the anti-join, are
its new lines; the others are known, and only repeat a line. Both are added as a run of level 0.
So every line is new in one run, and its documents are the ``n`` of that row and those of its
repeats. When a level holds ``fanout`` runs they are merged to one run of the next level, so that a
run is rewritten only about log(batches) times; no line is new in two of them.

Runs are dealt to buckets by hash and sorted: a batch is dealt out once, and joins with runs and
merges of them go bucket by bucket; nothing is dealt out or sorted again for them.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import deleted, in_slices, remove_folder, shared_folder, texts, written

MIN_DOCS = 10
BATCHES = 4
#: Lines for each bucket of a run, about 20 MB, and most buckets, beyond which they are larger.
BUCKET_LINES, MOST_BUCKETS = 1_000_000, 50_000
#: Most common lines that are broadcast to the rows: 16 MB. Beyond, they reach the texts by shuffle joins.
BROADCAST_ROWS = 1_000_000
#: Spark takes the order of a bucket's only file as given, and reads buckets as such for a union too.
_BUCKETS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def line_key(line: bytes) -> bytes:
    """The line without space and 0x09-0x0D at both ends, A-Z lower-cased."""
    return line.strip().lower()


def line_hash(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


@contextlib.contextmanager
def _in_order(spark: SparkSession, buckets: int):
    """What is planned here neither deals out nor sorts buckets again, and deals a batch to as many."""
    now = _BUCKETS | {"spark.sql.shuffle.partitions": str(buckets)}
    was = {k: spark.conf.get(k) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


class LineRuns:
    """Runs as bucketed tables in the shared folder. The driver keeps their names and levels only."""

    def __init__(self, spark: SparkSession, lines: int, fanout: int = 3, bucket_lines: int = BUCKET_LINES):
        """``lines``: about how many are to come, for as many buckets of ``bucket_lines``."""
        self.spark, self.fanout, self.folder = spark, fanout, shared_folder(spark, "line-runs")
        self.buckets = max(1, min(MOST_BUCKETS, -(-lines // bucket_lines)))
        self.levels: list[list[str]] = []

    def _table(self, rows: DataFrame) -> str:
        """``rows`` with one sorted file for each bucket; gives the table's name."""
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "hash") if self.buckets > 1 else rows.coalesce(1)
        dealt.write.bucketBy(self.buckets, "hash").sortBy("hash").option("compression", "none").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove_folder(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def marked(self, lines: DataFrame) -> DataFrame:
        """``lines`` (with ``hash``) and whether a run holds them, ``known``."""
        held = [f"held_{k}" for k in range(len(self.runs()))]
        out = lines
        for name, run in zip(held, self.runs()):
            out = out.join(run.where("NOT known").select("hash", F.lit(True).alias(name)).hint("merge"), "hash", "left")
        return out.select(*lines.columns, F.coalesce(*held, F.lit(False)).alias("known"))

    def new_lines(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` whose ``hash`` no run holds."""
        return self.marked(lines).where("NOT known").drop("known")

    def add(self, counts: DataFrame) -> None:
        """Add a batch ``(hash, n)``, one row for each hash, and compact levels that are full."""
        with _in_order(self.spark, self.buckets):
            run, level = self._table(self.marked(counts if self.buckets > 1 else counts.coalesce(1))), 0
            while True:
                self.levels += [[]] * (level + 1 - len(self.levels))
                self.levels[level] = [*self.levels[level], run]
                if len(self.levels[level]) < self.fanout:
                    break
                full, self.levels[level] = self.levels[level], []
                run = self._table(reduce(DataFrame.unionByName, map(self.spark.table, full)))
                self._drop(*full)
                level += 1

    def common(self, least: int) -> DataFrame:
        """``(hash, n)`` of the lines of ``least`` documents or more, written.

        A line that repeats in no later batch has all its documents where it is new; only of lines
        that do are the repeats added up and looked up there.
        """
        none = self.spark.createDataFrame([], "hash binary, n long, known boolean")
        repeats = reduce(DataFrame.unionByName, self.runs(), none).where("known")
        with _in_order(self.spark, self.buckets):
            again = self._table(repeats.groupBy("hash").agg(F.sum("n").alias("again")))
            total = F.col("n") + F.coalesce("again", F.lit(0))
            whole = [run.where("NOT known").join(self.spark.table(again).hint("merge"), "hash", "left").select("hash", total.alias("n")) for run in self.runs()]
            found = written(reduce(DataFrame.unionByName, whole, none.drop("known")).where(F.col("n") >= least), "line-common")
        self._drop(again)
        return found

    def close(self) -> None:
        """Remove the runs, once what was asked of them is written."""
        for level in self.levels:
            self._drop(*level)
        self.levels = []


def _lines(batches):
    """For each text its SHA-256 and the distinct hashes of its lines that have a key."""
    for part in in_slices(batches):
        raw = texts(part.column(0))
        keys = [{line_hash(k) for k in map(line_key, x.split(b"\n")) if k} for x in raw]
        yield pa.record_batch({"text_key": pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), "hashes": pa.array(map(list, keys), pa.list_(pa.binary()))})


class HashSet:
    """Hashes of 16 bytes in two sorted arrays, half the size of their Python objects and less."""

    def __init__(self, hashes: bytes):
        pairs = np.frombuffer(hashes, np.uint64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.first, self.second = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])

    def holds(self, hashes: bytes) -> np.ndarray:
        pairs = np.frombuffer(hashes, np.uint64).reshape(-1, 2)
        low, high = np.searchsorted(self.first, pairs[:, 0], "left"), np.searchsorted(self.first, pairs[:, 0], "right")
        found = np.zeros(len(pairs), bool)
        for step in range(int((high - low).max(initial=0))):  # one step, unless first halves agree
            at = np.flatnonzero(low + step < high)
            found[at] |= self.second[low[at] + step] == pairs[at, 1]
        return found


def _drop(mode: str, shared=None):
    """Drops common lines: those that ``shared`` holds, or without it those of a row's ``hits``."""

    def kept_lines(raw: list[bytes], hits: list) -> list[tuple[list[bytes], int]]:
        split = [x.split(b"\n") for x in raw]
        if shared is None:
            common = [set(x or ()) for x in hits]
            return [([x for x in lines if not own or not (k := line_key(x)) or line_hash(k) not in own], len(lines)) for lines, own in zip(split, common)]
        keys = [line_key(x) for lines in split for x in lines]
        found = np.array([bool(k) for k in keys])
        found &= shared.value.holds(b"".join(map(line_hash, keys)))
        out, at = [], 0
        for lines in split:
            drop = found[at : at + len(lines)]
            out.append(([x for x, y in zip(lines, drop.tolist()) if not y] if drop.any() else lines, len(lines)))
            at += len(lines)
        return out

    def run(batches):
        for part in in_slices(batches):
            hits = part.column(part.schema.get_field_index("hits")).to_pylist() if shared is None else ()
            done = kept_lines(texts(part.column(part.schema.get_field_index("text"))), hits)
            out = [b"\n".join(kept) for kept, _ in done]
            if mode == "digest":
                yield pa.record_batch({"doc_id": part.column(0), "n_lines": pa.array([n for _, n in done], pa.int64()), "n_dropped": pa.array([n - len(kept) for kept, n in done], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())})
            else:
                there = part.column(part.schema.get_field_index("text")).is_valid().to_pylist()
                yield pa.record_batch([part.column(0), pa.array([x.decode() if y else None for x, y in zip(out, there)], pa.string())], ["row", "text"])

    return run


def _text_key(column):
    return F.unhex(F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256))


def _without_common(docs: DataFrame, rows: DataFrame, mode: str, schema, min_docs: int, batches: int, most: int) -> DataFrame:
    """``rows`` (a first column, and ``text``) without the lines common in ``docs``."""
    spark = docs.sparkSession
    batch = F.spark_partition_id() % batches  # as rows come; the result does not depend on it
    lines = written(docs.select("text").mapInArrow(_lines, "text_key binary, hashes array<binary>").withColumn("batch", batch), "line-hashes", "batch", compression="none")
    runs = LineRuns(spark, lines.agg(F.sum(F.size("hashes"))).first()[0] or 0)
    for number in range(batches):
        runs.add(lines.where(F.col("batch") == number).select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n")))
    often = runs.common(min_docs)
    runs.close()
    if often.limit(most + 1).count() <= most:
        shared = spark.sparkContext.broadcast(HashSet(b"".join(often.select("hash").toArrow()["hash"].to_pylist())))
        deleted(lines)
        return rows.mapInArrow(_drop(mode, shared), schema)
    found = lines.select("text_key", F.explode("hashes").alias("hash")).join(often.select("hash"), "hash")
    hits = written(found.groupBy("text_key").agg(F.collect_set("hash").alias("hits")), "line-hits")
    deleted(lines)
    return rows.withColumn("text_key", _text_key(F.col("text"))).join(hits, "text_key", "left").select(*rows.columns, "hits").mapInArrow(_drop(mode), schema)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """What dropping lines common to many documents does to each document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Texts are split at \\n; a
    null or empty text is one empty line. A line's key is the line without space and 0x09-0x0D at
    both ends, A-Z lower-cased. Lines whose key is not empty and stands in ``min_docs`` documents
    or more (rows; repeated rows count each) go from every document. Returns ``doc_id``,
    ``n_lines``, ``n_dropped`` and ``kept_sha256`` (of the kept lines joined by \\n), one row per
    row. No rows: no rows. Up to ``most_broadcast`` common lines are broadcast, more are joined;
    the result is the same.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _without_common(docs, rows, "digest", "doc_id long, n_lines long, n_dropped long, kept_sha256 string", min_docs, batches, most_broadcast)


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, most_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` without the lines that ``line_report`` drops; all columns and rows stay, a null text stays null."""
    own = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("row"), "text")
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    out = _without_common(docs, rows, "rows", schema, min_docs, batches, most_broadcast)
    return out.select(*(F.col("text") if c == "text" else F.col(f"row.{x}").alias(c) for c, x in zip(docs.columns, own)))
