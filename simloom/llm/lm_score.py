"""Stupid-backoff language-model scores from counts of the whole corpus, computed relationally.

1. Documents are dealt to blocks of about 750,000 words, as they come. A block is kept as the
   numbers of its words in a list of the block's different words, by their 64-bit hashes.
2. A block's n-grams of all orders are exploded to rows ``(gram, block, n)``, one for each different
   n-gram of the block, named by 64-bit hashes. That is the count before the shuffle: an n-gram that
   stands everywhere is one row a block.
3. Rows are partitioned by hash and counted, which makes the count tables, and each row is joined with
   its count. Rows of n-grams that one block alone has need no answer; others go back to their block.
4. A block's n-grams meet their counts, every word gets its score, and scores are summed for each
   document.

Steps 2 and 3 are done in ``passes`` over ranges of hashes, step 4 in ``parts`` of the blocks, each
written before the next: what is on disk at a time is a part of the whole exchange.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, flat, in_slices, packed, short_shuffles, unpacked, written
from .words import window_hashes, word_hashes

ORDER, BACKOFF, LEAST = 3, 0.4, 2
BLOCK, PASSES, PARTS = 750_000, 5, 3
_ROWS = 1 << 16
_BLOCKS = pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()), ("numbers", pa.binary())])
_BLOCKS_SQL = "block long, n_words long, doc_ids array<long>, sizes binary, words binary, numbers binary"


def _deal(block_words: int):
    def flush(block: int, ids: list, sizes: list, hashes: list):
        words, numbers = np.unique(np.concatenate(hashes), return_inverse=True)
        kind = np.uint16 if len(words) <= 1 << 16 else np.uint32
        row = {"block": block, "n_words": len(numbers), "doc_ids": ids, "sizes": packed(np.concatenate(sizes).astype(np.uint32)), "words": words.tobytes(), "numbers": packed(numbers.astype(kind))}
        return pa.RecordBatch.from_pylist([row], _BLOCKS)

    def run(batches):
        from pyspark import TaskContext

        block, ids, sizes, hashes, held = TaskContext.get().partitionId() << 32, [], [], [], 0
        for part in in_slices(batches):
            own, first = word_hashes(*flat(part.column(1)))
            ids += part.column(0).to_pylist()
            sizes.append(np.diff(first))
            hashes.append(own)
            held += len(own)
            if held >= block_words:
                yield flush(block, ids, sizes, hashes)
                block, ids, sizes, hashes, held = block + 1, [], [], [], 0
        if ids:
            yield flush(block, ids, sizes, hashes)

    return run


def _places(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of a block the place of each document's first word, and how many words of its document stand before each word."""
    sizes = unpacked(row["sizes"]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return first, (np.arange(first[-1]) - np.repeat(first[:-1], sizes)).astype(np.uint32)


def _grams(row: dict, before: np.ndarray, order: int):
    """For each width the hashes of a block's n-grams, and the places of their last words; one width at a time."""
    hashes = np.frombuffer(row["words"], np.uint64)[unpacked(row["numbers"])]
    yield hashes, slice(None)
    for width in range(2, order + 1):
        at = np.flatnonzero(before >= width - 1)
        yield window_hashes(hashes, width)[at - width + 1], at


def _exploded(order: int, passes: int, number: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                mine = [x[(x >> np.uint64(32)) * np.uint64(passes) >> np.uint64(32) == number] for x, _ in _grams(row, _places(row)[1], order)]
                values, counts = np.unique(np.concatenate(mine), return_counts=True)
                for at in range(0, len(values), _ROWS):
                    own = values[at : at + _ROWS]
                    yield pa.record_batch({"gram": own.view(np.int64), "block": np.full(len(own), row["block"], np.int64), "n": counts[at : at + _ROWS].astype(np.int64)})

    return run


def _score(total: int, order: int, backoff: float, least: int):
    def run(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        (row,) = blocks.to_pylist()
        first, ahead = _places(row)
        known, answers = counts["gram"].to_numpy().view(np.uint64), counts["total"].to_numpy()
        ranks = np.argsort(known)
        known, answers = known[ranks], answers[ranks]
        logs = before = None  # before: the count of the n-gram of one width less that ends at each word
        for width, (grams, at) in enumerate(_grams(row, ahead, order), 1):
            values, place, own = np.unique(grams, return_inverse=True, return_counts=True)
            spot = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            there = known[spot] == values if len(known) else np.zeros(len(values), bool)
            own[there] = answers[spot[there]]
            here = own[place].astype(float)
            if width == 1:
                logs = np.log(here / total)
            else:
                logs[at] += np.log(backoff)
                seen = here >= least
                logs[at[seen]] = np.log(here[seen] / before[at[seen] - 1])
            before = np.zeros(len(logs))
            before[at] = here
        sums = np.array([logs[a:b].sum() for a, b in zip(first[:-1].tolist(), first[1:].tolist())])
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": np.diff(first), "log_score": sums})

    return run


def _answers(blocks: DataFrame, order: int, passes: int, number: int) -> DataFrame:
    """``(gram, block, total)`` of one range of hashes, written: the counts of n-grams that several blocks have, for each of those."""
    grams = blocks.select("block", "sizes", "words", "numbers").mapInArrow(_exploded(order, passes, number), "gram long, block long, n long")
    counted = grams.select("gram", "block", "n", F.sum("n").over(Window.partitionBy("gram")).alias("total"))
    # sorted by hash as they are, differences of hashes are shorter
    short = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#gram": "false"}
    return written(counted.where("total > n").select("gram", "block", "total"), "lm-counts", **short)


def _scored(blocks: DataFrame, answers: list[DataFrame], score, parts: int, number: int) -> DataFrame:
    """The scores of one part of the blocks, written."""
    mine = F.pmod("block", F.lit(parts)) == number
    known = reduce(DataFrame.unionByName, (x.where(mine) for x in answers))
    own = blocks.where(mine).select("block", "doc_ids", "sizes", "words", "numbers")
    return written(own.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, log_score double"), "lm-scores")


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST, block_words: int = BLOCK, passes: int = PASSES, parts: int = PARTS) -> DataFrame:
    """Stupid-backoff score of each text under the counts of all texts.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Words are runs of characters
    other than space and 0x09-0x0D, A-Z lower-cased. With the n - 1 words before it, for the largest n
    up to ``order`` that the document has, a word's score is ``c(n words) / c(the n - 1 before)`` if the
    n words stand ``least`` times or more in the corpus, else ``backoff`` times its score with one
    word less before it; with none it is ``c(word) / N``. A text's own n-grams are in the counts: with
    ``least`` 1 nothing is ever unseen, with 2 an n-gram that stands in it once only is. Returns
    ``doc_id``, ``n_words``, ``log_score`` (sum of natural logarithms, 6 decimals) and
    ``word_log_score`` (a word's mean), one row per row. A text without words, null too, has 0
    words, sum 0 and a null mean. Repeated rows count each. No rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    blocks = written(rows.mapInArrow(_deal(block_words), _BLOCKS_SQL), "lm-blocks", compression="none")
    total = blocks.agg(F.sum("n_words")).first()[0] or 1
    answers, out = [], None
    with short_shuffles(spark):
        for number in range(passes):
            answers.append(_answers(blocks, order, passes, number))
        for number in range(parts):
            part = _scored(blocks, answers, _score(total, order, backoff, least), parts, number)
            out = part if out is None else out.unionByName(part)
    deleted(blocks, *answers)
    return out.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("word_log_score"))
