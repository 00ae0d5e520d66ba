"""Token ids of texts in Parquet files that can be read in part: some columns, or some documents.

Documents are dealt to shards by ranges of ``doc_id`` and sorted in them; a task encodes its shard in
that order and Spark writes it as one file. A row is a document, or ``PART`` ids of a longer one:

* ``ids``, a list column, is dictionary-encoded: a row group holds few different ids;
* positions and lengths are delta-encoded, as they rise or are small;
* row groups and pages are of set sizes, and pages are listed in column and offset indexes, so that a
  reader of some documents opens only the pages that its ``doc_id`` filter leaves, and a reader of lengths
  or places touches no ids.

Encoding goes through the tokenizer for each different chunk of a batch only. A chunk begins at a
document's start, before a single space between two characters that are surely no white space, or at a
mark after a letter: the byte-level tokenizer's own splitting never reaches across such a place.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import flat, in_slices, shared_folder

END = 0
#: Most ids of a row; bytes of text encoded at once; bytes of text of a shard.
PART, PIECE, SHARD_BYTES = 1 << 16, 1 << 22, 32 << 20
#: Chunks that are encoded as one text.
_JOINED = 4096
#: Chunks whose ids a worker remembers; beyond, it starts to remember anew.
REMEMBERED = 3 << 18
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 1 << 18, 2048
_SQL = "shard int, doc_no long, part int, doc_id long, start long, n_ids int, ids array<int>"
_SCHEMA = pa.schema([("shard", pa.int32()), ("doc_no", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int32()), ("ids", pa.list_(pa.int32()))])

_BYTE = np.arange(256)
_ASCII = (_BYTE > 0x20) & (_BYTE < 0x7F)
_TWO = (_BYTE >= 0xC3) & (_BYTE <= 0xDF)  # first bytes of two-byte characters that are no white space
_NEXT = _ASCII | _TWO | (_BYTE >= 0xEA)
_LETTER = ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
_MARK = np.isin(_BYTE, np.frombuffer(b",.;:!?", np.uint8))


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of single spaces between two characters that are surely no white space, and of marks after a letter of A-Z, a-z."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at >= 2) & (at < len(data) - 1)]
    before = data[at - 1]
    at = at[_NEXT[data[at + 1]] & (_ASCII[before] | ((before >= 0x80) & _TWO[data[at - 2]]))]
    marks = np.flatnonzero(_MARK[data])
    marks = marks[marks >= 1]
    return np.sort(np.concatenate([at, marks[_LETTER[data[marks - 1]]]]), kind="stable")


class Encoder:
    """A tokenizer that encodes each different chunk of text once; tasks of one worker share it."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names, added = self.tokenizer.get_vocab(), self.tokenizer.get_added_tokens_decoder()
        self.sizes = np.zeros(1 + max(names.values()), np.int64)  # a byte-level token has a character for each byte
        for name, k in names.items():
            self.sizes[k] = len(name.encode()) if k in added else len(name)
        self.remembered, self.known = remembered, {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and for each text the place of its first id (one more at the end)."""
        edges = np.sort(np.concatenate([cuts(data), offsets]), kind="stable")
        edges = edges[np.append(True, edges[1:] != edges[:-1])]
        chunks = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        found = chunks.dictionary_encode()
        values = found.dictionary.to_pylist()
        if len(self.known) + len(values) > self.remembered:
            self.known, self.ids, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        new = [x for x in values if x not in self.known]
        if new:
            self._learn(new)
        number = np.fromiter((self.known[x] for x in values), np.int64, len(values))[found.indices.to_numpy(zero_copy_only=False)]
        first, sizes = self.ends[number], self.ends[number + 1] - self.ends[number]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends[:-1], sizes)] if len(sizes) else np.zeros(0, np.int32)
        return ids, ends[np.searchsorted(edges, offsets)]


    def _learn(self, new: list[bytes]) -> None:
        """Encode chunks. Those with a cut on either side are joined to longer texts; sizes of tokens tell which are whose."""
        new.sort(key=_joins)
        alone = sum(not _joins(x) for x in new)
        texts = [x.decode() for x in new[:alone]]
        texts += [b"".join(new[k : k + _JOINED]).decode() for k in range(alone, len(new), _JOINED)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int32)
        ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(x) for x in new])) + 1
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.ends = np.append(self.ends, self.ends[-1] + ends)
        self.ids = np.append(self.ids, ids)


def _joins(chunk: bytes) -> bool:
    """Whether a chunk begins as after a cut and ends as before one."""
    return len(chunk) > 2 and chunk[0] == 0x20 and bool(_NEXT[chunk[1]]) and bool(_ASCII[chunk[-1]] or chunk[-1] >= 0x80 and _TWO[chunk[-2]])


def _pieces(data: np.ndarray, offsets: np.ndarray, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts as they are; a single one beyond ``piece`` bytes in pieces that end where a chunk does."""
    if len(offsets) > 2 or offsets[-1] <= piece:
        yield data, offsets
        return
    at, size = 0, piece
    while at < len(data):
        found = cuts(data[at : at + size]) if at + size < len(data) else np.array([len(data) - at])
        if not len(found):  # no such place in so many bytes: look further
            size *= 2
            continue
        yield data[at : at + found[-1]], np.array([0, found[-1]])
        at, size = at + int(found[-1]), piece


_encoders: dict[tuple, Encoder] = {}


def _encoder(*args) -> Encoder:
    """An encoder that tasks of one worker hand on, with what it remembers."""
    if args not in _encoders:
        _encoders.clear()
        _encoders[args] = Encoder(*args)
    return _encoders[args]


def _encode(path: str, most: int, piece: int, remembered: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, shard, doc_no, start = _encoder(path, remembered), TaskContext.get().partitionId(), 0, 0
        for rows in in_slices(batches, piece):
            data, offsets = flat(rows.column(1))
            doc_ids, part = rows.column(0).to_pylist(), 0
            pieces = list(_pieces(data, offsets, piece))
            for nth, (data, offsets) in enumerate(pieces):
                ids, first = encoder.encode(data, offsets)
                if last := nth + 1 == len(pieces):
                    ids = np.insert(ids, first[1:], END)
                    first = first + np.arange(len(first))
                rows = []
                for k, doc_id in enumerate(doc_ids):
                    for at in range(first[k], max(first[k + 1], first[k] + 1), most):
                        own = ids[at : min(at + most, first[k + 1])]
                        if len(own):
                            rows.append((shard, doc_no, part, doc_id, start, len(own), at))
                            part, start = part + 1, start + len(own)
                    if last:
                        doc_no, part = doc_no + 1, 0
                if rows:
                    *columns, at = zip(*rows)
                    lists = pa.ListArray.from_arrays(pa.array([*at, at[-1] + columns[5][-1]], pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.record_batch([*(pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)), lists], schema=_SCHEMA)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, part: int = PART, piece: int = PIECE, remembered: int = REMEMBERED) -> None:
    """Encode all texts of ``docs`` (``doc_id``, ``text``) and write them to ``path`` in ascending ``doc_id`` order.

    ``tokenizer`` is the path of a byte-level tokenizer file that all executors can read. Each document's ids end with
    ``END``; a null or empty text has that id only. Null ids come first; rows of one ``doc_id`` each count, in the order of a hash of their
    texts. A row holds ``part`` ids at most. Texts are encoded whole; one beyond ``piece`` bytes in pieces that end at
    a cut, which take more bytes where there is none. No rows: no document.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    shards = max(1, -(-size // SHARD_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "tie", "row"]  # a hot id is many rows that can still be split
    dealt = rows.repartitionByRange(int(shards), *order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.block.size": str(ROW_GROUP), "parquet.page.size": str(PAGE), "parquet.page.row.count.limit": str(PAGE_ROWS), "compression": "zstd"}
    dealt.mapInArrow(_encode(tokenizer, part, piece, remembered), _SQL).write.mode("overwrite").options(**options).parquet(path)


class TokenFiles:
    """What ``write_tokens`` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.schema(_SQL).parquet(path)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``start`` counted over all shards in place of the own one. One row for each shard is added up in one place and broadcast."""
        sums = self.rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")

    def metadata(self) -> DataFrame:
        """``(shard, doc_no, doc_id, start, n_tokens)`` of each document; ids are not read."""
        rows = self.rows.groupBy("shard", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_ids").alias("n_tokens"))
        return self._placed(rows).select("shard", "doc_no", "doc_id", "start", "n_tokens")

    def tokens(self, *doc_ids: int) -> DataFrame:
        """``(shard, doc_no, part, doc_id, start, ids)`` of all documents or of some, whose pages alone are read."""
        rows = self.rows.where(F.col("doc_id").isin(*doc_ids)) if doc_ids else self.rows
        return self._placed(rows).select("shard", "doc_no", "part", "doc_id", "start", "ids")

    def digests(self) -> DataFrame:
        """``(doc_id, start, n_tokens, ids_crc32)`` of each document, the checksum over its ids as four little-endian bytes each."""
        rows = self.rows.select("shard", "doc_no", "part", "doc_id", "start", "ids")
        parts = rows.mapInArrow(_checked, "shard int, doc_no long, part int, doc_id long, start long, n long, crc long")
        docs = parts.groupBy("shard", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("part", "n", "crc"))).alias("parts"))
        placed = self._placed(docs).select("doc_id", "start", "n_tokens", F.col("parts.n").alias("sizes"), F.col("parts.crc").alias("crcs"))
        return placed.mapInArrow(_combined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _checked(batches):
    for rows in batches:
        lists = rows.column(5)
        offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.record_batch([*rows.columns[:5], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], names=["shard", "doc_no", "part", "doc_id", "start", "n", "crc"])


def _product(a: int, b: int) -> int:
    """The product of two polynomials of bits, the highest power in the lowest bit, modulo that of the checksum."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc32(first: int, second: int, size: int) -> int:
    """The checksum of two runs of bytes out of those of each; the second has ``size`` bytes."""
    step, power = 1 << 23, 1 << 31  # the eighth power of x, for a byte; one
    while size:
        if size & 1:
            power = _product(power, step)
        step, size = _product(step, step), size >> 1
    return _product(power, first) ^ second


def _combined(batches):
    for rows in batches:
        sizes, crcs = rows.column(3), rows.column(4)
        offsets, values = crcs.offsets.to_numpy(), crcs.values.to_numpy()
        out = values[offsets[:-1]].copy()
        lengths = sizes.values.to_numpy()
        for k in np.flatnonzero(np.diff(offsets) > 1).tolist():
            whole = int(values[offsets[k]])
            for at in range(offsets[k] + 1, offsets[k + 1]):
                whole = joined_crc32(whole, int(values[at]), 4 * int(lengths[at]))
            out[k] = whole
        yield pa.record_batch([*rows.columns[:3], pa.array(out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, **sizes: int) -> TokenFiles:
    """The files of all texts, in a fresh folder of the shared one."""
    path = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **sizes)
    return TokenFiles(docs.sparkSession, path)
