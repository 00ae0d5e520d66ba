"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each partition hashes its normalised texts (SHA-256; the first 64 bits are the fingerprint),
   sorts the distinct fingerprints and sends them to owners by value, as Rice-coded differences.
2. An owner decodes what it got, finds the fingerprints that more than one partition sent, and
   replies to each with a bitmap in the order sent. What a partition holds twice it knows itself.
3. Only rows with a suspect fingerprint are compared byte by byte: each partition sends every
   different suspect text once. Two different texts of one SHA-256 would stop the job. Rows that
   are no suspects are not joined with anything.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, in_slices, partitions, texts, written

#: Most suspect fingerprints (16 MB), and most groups (100 MB), that are broadcast. Beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")

_SENT = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int64()), ("code", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("slots", pa.list_(pa.int32())), ("twice", pa.list_(pa.bool_())), ("shas", pa.list_(pa.binary()))])
_SENT_SQL = "block long, owner int, n long, code binary, doc_ids array<long>, slots array<int>, twice array<boolean>, shas array<binary>"


def normalised(text: bytes) -> bytes:
    """Each run of space and 0x09-0x0D becomes one space."""
    return _SPACE.sub(b" ", text)


def golomb_encode(values: np.ndarray) -> bytes:
    """Rice code (a Golomb code with a power of two) of the differences of sorted distinct uint64 values."""
    values = np.asarray(values, np.uint64)
    if not len(values):
        return b"\0"
    steps = np.diff(values, prepend=np.uint64(0))
    bits = max(0, int(int(values[-1]) // len(values)).bit_length() - 1)
    high = (steps >> np.uint64(bits)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = ((steps[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return bytes([bits]) + len(values).to_bytes(8, "little") + np.packbits(low).tobytes() + np.packbits(unary).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if len(code) < 2:
        return np.zeros(0, np.uint64)
    bits, n = code[0], int.from_bytes(code[1:9], "little")
    size = (n * bits + 7) // 8
    low = np.unpackbits(np.frombuffer(code, np.uint8, size, 9), count=n * bits).reshape(n, bits).astype(np.uint64)
    steps = (low << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if bits else np.zeros(n, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, -1, 9 + size)))[:n]
    high = np.diff(ends, prepend=-1) - 1
    return np.cumsum(steps + (high.astype(np.uint64) << np.uint64(bits)), dtype=np.uint64)


def _send(owners: int, block_rows: int):
    def flush(block: int, ids: list, shas: list):
        prints = np.array([int.from_bytes(x[:8], "big") for x in shas], np.uint64)
        order = np.argsort(prints, kind="stable")
        owner = ((prints[order] >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])), len(owner))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            here = order[a:b]
            values, slot, times = np.unique(prints[here], return_inverse=True, return_counts=True)
            rows.append({"block": block, "owner": int(owner[a]), "n": len(values), "code": golomb_encode(values), "doc_ids": [ids[i] for i in here.tolist()], "slots": slot.astype(np.int32), "twice": (times > 1)[slot], "shas": [shas[i] for i in here.tolist()]})
        return pa.RecordBatch.from_pylist(rows, _SENT)

    def run(batches):
        from pyspark import TaskContext

        block, ids, shas = TaskContext.get().partitionId() << 24, [], []
        for part in in_slices(batches):
            ids += part.column(0).to_pylist()
            shas += [hashlib.sha256(normalised(x)).digest() for x in texts(part.column(1))]
            if len(ids) >= block_rows:
                yield flush(block, ids, shas)
                block, ids, shas = block + 1, [], []
        if ids:
            yield flush(block, ids, shas)

    return run


def _own(table: pa.Table) -> pa.Table:
    """For each block's code a bitmap, as 64-bit words, of what other blocks sent too."""
    sent = [golomb_decode(x) for x in texts(table["code"])]
    values, times = np.unique(np.concatenate(sent), return_counts=True)
    shared = values[times > 1]
    out = []
    for x in sent:
        place = np.minimum(np.searchsorted(shared, x), max(0, len(shared) - 1))
        bits = shared[place] == x if len(shared) else np.zeros(len(x), bool)
        out.append(np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view(np.int64).tolist())
    return pa.table({"block": table["block"], "owner": table["owner"], "bitmap": pa.array(out, pa.list_(pa.int64()))})


def _once(batches):
    """Every different normalised text of a partition, with its SHA-256: once, or again when it has been forgotten meanwhile."""
    seen = set()
    for part in in_slices(batches):
        rows = []
        for x in map(normalised, texts(part.column(0))):
            if (sha := hashlib.sha256(x).digest()) not in seen:
                seen.add(sha)
                rows.append((sha, int.from_bytes(sha[:8], "big", signed=True), x))
        if rows:
            yield pa.record_batch(list(map(pa.array, zip(*rows))), ["sha", "fingerprint", "bytes"])
        if len(seen) > 200_000:
            seen.clear()


def exact_dedup(docs: DataFrame, block_rows: int = 1_000_000) -> DataFrame:
    """Which row of each group of equal texts stays.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Texts are equal when
    identical after replacing each run of space and 0x09-0x0D by one space; null counts as empty.
    Returns one row per row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    The row with the smallest ``doc_id`` stays, a null one only if the group has no other. Of
    repeated rows with this ``doc_id`` exactly one stays. No rows: no rows.
    """
    spark = docs.sparkSession
    sent = written(docs.select("doc_id", "text").mapInArrow(_send(partitions(spark), block_rows), _SENT_SQL), "dedup-sent", compression="none")
    bitmaps = sent.select("block", "owner", "code").groupBy("owner").applyInArrow(_own, "block long, owner int, bitmap array<long>")
    rows = sent.drop("code", "n").join(bitmaps, ["block", "owner"]).select("block", "owner", "bitmap", F.posexplode(F.arrays_zip("doc_ids", "slots", "twice", "shas")).alias("place", "x"))
    suspect = F.col("x.twice") | F.expr("shiftright(element_at(bitmap, CAST(x.slots DIV 64 AS INT) + 1), x.slots % 64) & 1 = 1")
    rows = written(rows.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.shas").alias("sha"), suspect.alias("suspect"), "block", "owner", "place"), "dedup-rows")
    deleted(sent)
    suspects = rows.where("suspect")
    prints = suspects.select(F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long").alias("fingerprint")).distinct()
    prints = written(prints, "dedup-suspects")
    once = docs.select("text").mapInArrow(_once, "sha binary, fingerprint long, bytes binary")
    once = once.join(_small(prints), "fingerprint", "left_semi")
    same = once.groupBy("fingerprint", "sha", "bytes").agg(F.lit(1).alias("one")).groupBy("sha").agg(F.sum("one").alias("texts"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "block", "owner", "place")
    groups = suspects.groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    checked = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts have the same SHA-256, or a suspect has no text")).cast("long"))
    # written, so that Spark can split the rows of a large group in the join
    groups = written(groups.join(same, "sha", "left").select("sha", "first", checked.alias("group_size")), "dedup-groups")
    deleted(prints)
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    kept = (F.col("first.block") == F.col("block")) & (F.col("first.owner") == F.col("owner")) & (F.col("first.place") == F.col("place"))
    own = suspects.join(_small(groups), "sha").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), sha)
    alone = rows.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return own.unionByName(alone)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows
