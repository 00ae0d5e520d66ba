"""Benchmark decontamination by a broadcast set of the benchmark's normalised word windows.

The benchmark is a stated, small query set. Its windows are broadcast in blocks of at most
``most_words`` benchmark words; each block is one pass over all documents. Words of a document
are replaced by the numbers of the benchmark's words (0: none of them), windows are found by a
rolling hash of the numbers in the sorted hashes of the block, and each hit is verified word by word.
Hits of a block are carried to the next pass as bits, so that the last one sees them all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, plain_names, texts, written
from .words import ALNUM, LOWER, mix, spans

WINDOW = 10
_STEP = np.uint64(0x9FB21C651E98DF25)


def word_list(text: bytes) -> list[bytes]:
    data = np.frombuffer(text, np.uint8)
    return np.where(ALNUM[data], LOWER[data], 0x20).astype(np.uint8).tobytes().split()


def _roll(numbers: np.ndarray, width: int) -> np.ndarray:
    n = len(numbers) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = numbers[:n].astype(np.uint64)
    for k in range(1, width):
        h *= _STEP
        h += numbers[k : k + n].astype(np.uint64)
    return mix(h)


class Windows:
    """The windows of a block of benchmark items by width, as arrays sorted by hash; about 60 bytes for each, and a dictionary of the words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        found: dict[int, tuple[list, list]] = {}
        for place, (_, text) in enumerate(items):
            own = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in word_list(text)], np.int32)
            if width := min(window, len(own)):
                rows, places = found.setdefault(width, ([], []))
                rows.append(np.lib.stride_tricks.sliding_window_view(own, width))
                places.append(np.full(len(own) - width + 1, place, np.int32))
        self.by_width = {}
        for width, (rows, places) in found.items():
            rows, places = np.concatenate(rows), np.concatenate(places)
            hashes = _roll(rows.reshape(-1), width)[::width]
            order = np.argsort(hashes, kind="stable")
            self.by_width[width] = hashes[order], rows[order], places[order]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words stand in an occurrence of a window, and the items of which a window occurs."""
        hit = np.zeros(len(words) + 1, np.int64)
        items: set = set()
        get = self.numbers.get
        numbers = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate([[0], np.cumsum(numbers > 0)])
        for width, (hashes, rows, places) in self.by_width.items():
            at = np.flatnonzero(known[width:] - known[:-width] == width) if len(words) >= width else ()
            if not len(at):
                continue
            rolled = _roll(numbers, width)[at]
            first = np.searchsorted(hashes, rolled)
            met = hashes[np.minimum(first, len(hashes) - 1)] == rolled
            for place, h, k in zip(at[met].tolist(), rolled[met], first[met].tolist()):
                while k < len(hashes) and hashes[k] == h:
                    if np.array_equal(rows[k], numbers[place : place + width]):
                        hit[place] += 1
                        hit[place + width] -= 1
                        items.add(self.items[places[k]])
                    k += 1
        return np.cumsum(hit[:-1]) > 0, items


def _blocks(benchmark: DataFrame, most_words: int):
    """The benchmark's windows in blocks; one without windows if it is empty."""
    block, held, given = [], 0, 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator(prefetchPartitions=False):
        text = (row[1] or "").encode()
        block.append((row[0], text))
        held += len(text) // 4 + 1
        if held >= most_words:
            yield Windows(block)
            block, held, given = [], 0, given + 1
    if block or not given:
        yield Windows(block)


def _scan(shared, finish):
    """Adds a block's hits to the state, the last two columns: hit words as bits, and the item ids.

    ``finish(part, raw, found)`` makes the result out of the rows without state, their texts and,
    for each, its number of words, hit words and item ids; None keeps the state for a next block.
    """

    def run(batches):
        windows = shared.value
        for part in in_slices(batches):
            raw = texts(part.column(part.schema.get_field_index("text")))
            plain, found = part.select(list(range(part.num_columns - 2))), []
            for text, bits, names in zip(raw, part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                words = word_list(text)
                hits, items = windows.scan(words)
                if bits:
                    hits |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(words)).astype(bool)
                found.append((len(words), hits, sorted(items.union(names or ()) - {None})))
            if finish:
                yield finish(plain, raw, found)
            else:
                bits = [np.packbits(hits).tobytes() if hits.any() else None for _, hits, _ in found]
                yield pa.record_batch([*plain.columns, pa.array(bits, pa.binary()), pa.array([names for *_, names in found], pa.list_(pa.string()))], part.schema.names)

    return run


def _digest(part: pa.RecordBatch, raw: list[bytes], found: list) -> pa.RecordBatch:
    n_hit = [int(hits.sum()) for _, hits, _ in found]
    shas = [hashlib.sha256(",".join(names).encode()).hexdigest() for *_, names in found]
    columns = {"n_words": pa.array([n for n, *_ in found], pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(names) for *_, names in found], pa.int64())}
    return pa.record_batch({"doc_id": part.column(0), **columns, "items_sha256": pa.array(shas, pa.string()), "contaminated": pa.array([n > 0 for n in n_hit], pa.bool_())})


def _drop(part: pa.RecordBatch, raw: list[bytes], found: list) -> pa.RecordBatch:
    return part.filter(pa.array([not hits.any() for _, hits, _ in found], pa.bool_()))


def _cut(part: pa.RecordBatch, raw: list[bytes], found: list) -> pa.RecordBatch:
    """A run of hit words goes with what stands between them."""
    at, kept = part.schema.get_field_index("text"), []
    for text, (_, hits, _), there in zip(raw, found, part.column(at).is_valid().to_pylist()):
        if hits.any():
            data = np.frombuffer(text, np.uint8)
            starts, ends, _ = spans(data, np.array([0, len(data)]), ALNUM)
            drop = np.zeros(len(data) + 1, np.int64)
            np.add.at(drop, starts[np.flatnonzero(hits & ~np.append(False, hits[:-1]))], 1)
            np.add.at(drop, ends[np.flatnonzero(hits & ~np.append(hits[1:], False))], -1)
            text = data[np.cumsum(drop[:-1]) == 0].tobytes()
        kept.append(text.decode() if there else None)
    return part.set_column(at, part.schema.field(at), pa.array(kept, part.schema.field(at).type))


def _passes(docs: DataFrame, benchmark: DataFrame, most_words: int, finish, schema) -> DataFrame:
    """One pass over ``docs`` for each block of the benchmark; passes before the last are written with their state."""
    broadcast, state = docs.sparkSession.sparkContext.broadcast, "state"
    while any(c.lower().startswith(state) for c in docs.columns):
        state += "_"
    rows = docs.select("*", F.lit(None).cast("binary").alias(f"{state}_bits"), F.lit(None).cast("array<string>").alias(f"{state}_items"))
    blocks = _blocks(benchmark, most_words)
    windows = next(blocks)
    for following in blocks:
        rows = written(rows.mapInArrow(_scan(broadcast(windows), None), rows.schema), "decontaminate-pass")
        windows = following
    return rows.mapInArrow(_scan(broadcast(windows), finish), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, most_words: int = 1_000_000) -> DataFrame:
    """How much of each document stands in the benchmark.

    Windows are 10 consecutive words of an item (words: 0-9, a-z and code points above 0x7F, A-Z
    lower-cased); an item of fewer words, but not none, is one window. ``docs`` needs ``doc_id``
    and ``text``, ``benchmark`` needs ``item_id`` and ``text``; other columns are not read.
    Returns ``doc_id``, ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``n_items``, ``items_sha256`` (of the sorted item ids as strings, comma-joined) and
    ``contaminated`` (``n_hit > 0``), one row per row. Null and empty texts have no words. An item
    with a null id makes hits but is not counted or listed; repeated items count once. An empty
    benchmark hits nothing. A benchmark beyond ``most_words`` words, about 150 MB of windows and words, is
    taken in blocks, each a pass over the documents; the result is the same.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _passes(rows, benchmark, most_words, _digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, whole: bool = False, most_words: int = 1_000_000) -> DataFrame:
    """``docs`` without the benchmark's passages: their spans are cut out, or with ``whole`` the documents go.

    Columns stay as they are, whatever their names. A null text stays null. A benchmark beyond
    ``most_words`` words is taken in blocks, each a pass over the documents. Spans are cut once all
    blocks are searched, so that one span hides no other.
    """
    rows = plain_names(docs, "text")
    return _passes(rows, benchmark, most_words, _drop if whole else _cut, rows.schema).toDF(*docs.columns)
