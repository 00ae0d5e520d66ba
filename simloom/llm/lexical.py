"""Ranked lexical search by a bit-sliced impact index.

Documents are dealt to blocks as they come. In a block each term has its documents' places and the
bits of its impacts there, a bitmap for each bit: ``SLICES`` bitmaps over the term's own documents. An
impact is ``(1000000000 tf) div (1000 tf + 8 m)``, ``m`` growing with the document's length. It needs two
numbers of the whole corpus only, so that a block is made in one task and never shuffled.

A search reads the rows of the queries' terms and groups them by block. There

1. terms' bitmaps are multiplied by the weights that their document counts give, by shifting and adding
   with carry, all terms at once in words of 64 documents;
2. bitmaps are spread to the block's documents, and those of a query's terms are added up with carry, a
   round for each term, many queries at a time;
3. the best ``k`` are found from the most significant sum bitmap down: documents with the bit stay if
   they are enough, else they are in and the search goes on among the others.

Blocks' best are ranked once more for each query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, flat, in_slices, written
from .terms import Names, counted
from .words import ALNUM, spans

K1, MOST_B, K = 1000, 75, 10
#: Impacts are below 10**6.
SLICES = 20
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 21
#: Terms of queries that are searched for at once, and bytes of spread bitmaps that a task holds.
QUERY_TERMS, SPREAD_BYTES = 1_000_000, 64 << 20
#: A block's own row has no term: ``df`` documents, their ids in ``places``, and how many have none in ``slices``.
_SQL = "block long, term string, df int, places binary, slices binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("places", pa.binary()), ("slices", pa.binary())])
_ROWS = 1 << 15


def _blobs(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges - edges[0]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[edges[0] : edges[-1]]))])


def _sliced(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the values' bits: those of each run of values, from ``first[k]`` on, in bytes of their own, one bit after the other."""
    sizes = np.diff(first)
    width = -(-sizes // 8)
    edges = np.concatenate([[0], np.cumsum(width)])
    bit_at = np.arange(len(values)) + np.repeat(8 * edges[:-1] - first[:-1], sizes)
    own = np.repeat(np.arange(len(sizes)), width)
    within = np.arange(edges[-1]) - edges[own] + SLICES * edges[own]
    out, bits = np.zeros(SLICES * edges[-1], np.uint8), np.zeros(8 * edges[-1], np.uint8)
    for s in range(SLICES):
        bits[bit_at] = values >> s & 1
        out[within + s * width[own]] = np.packbits(bits)
    return out, SLICES * edges


def _block(block: int, ids: list, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, names: Names, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """A block's rows, its own first, then its terms in their order."""
    nulls = np.array([x is None for x in ids])
    numbers = np.array([x or 0 for x in ids], np.int64)
    order = np.lexsort((numbers, nulls))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    yield pa.record_batch([[block], [None], [len(ids)], [numbers[order].tobytes()], [int(nulls.sum()).to_bytes(4, "little")]], schema=_SCHEMA)
    if not len(doc):
        return
    hashes, strings = names.all()
    sorted_by_name = pc.sort_indices(strings).to_numpy()
    place = np.empty(len(hashes), np.int64)
    place[sorted_by_name] = np.arange(len(hashes))
    keys, at = np.unique(place[np.searchsorted(hashes, term)] * len(ids) + rank[doc], return_inverse=True)
    tf = np.bincount(at, tf).astype(np.int64)  # parts of a long text come apart
    term, doc = np.divmod(keys, len(ids))
    lengths = np.bincount(doc, tf, len(ids)).astype(np.int64)
    m = 100 - MOST_B + MOST_B * lengths * n_docs // n_terms
    impact = 1_000_000_000 * tf // (K1 * tf + 8 * m[doc])
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(hashes)))])
    places = doc.astype(np.uint16).view(np.uint8)
    strings = strings.take(pa.array(sorted_by_name))
    for a in range(0, len(hashes), _ROWS):
        own = first[a : a + _ROWS + 1]
        slices, edges = _sliced(impact[own[0] : own[-1]], own - own[0])
        n = len(own) - 1
        yield pa.record_batch([pa.array(np.full(n, block)), strings[a : a + n], pa.array(np.diff(own).astype(np.int32)), _blobs(places, 2 * own), _blobs(slices, edges)], schema=_SCHEMA)


def _sizes(batches):
    """Texts with a term, and all terms."""
    docs = terms = 0
    for rows in in_slices(batches):
        _, _, first = spans(*flat(rows.column(0)), ALNUM)
        docs, terms = docs + int((first[1:] > first[:-1]).sum()), terms + int(first[-1])
    yield pa.record_batch([[docs], [terms]], names=["docs", "terms"])


def _indexed(n_docs: int, n_terms: int, block_docs: int, block_postings: int):
    def run(batches):
        from pyspark import TaskContext

        block, ids, found, names, held = TaskContext.get().partitionId() << 32, [], [], Names(), 0
        for rows, text, term, tf, own in counted(batches, ALNUM):
            if rows is not None:
                if ids and (len(ids) + rows.num_rows > block_docs or held >= block_postings):
                    yield from _block(block, ids, *map(np.concatenate, zip(*found)), names, n_docs, n_terms)
                    block, ids, found, names, held = block + 1, [], [], Names(), 0
                before, ids = len(ids), ids + rows.column(0).to_pylist()
            names.add(own)
            found.append((text.astype(np.int32) + before, term, tf.astype(np.int32)))
            held += len(term)
        if ids:
            yield from _block(block, ids, *map(np.concatenate, zip(*found)), names, n_docs, n_terms)

    return run


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The index of all ``docs`` (``doc_id``, ``text``), written to the shared folder: ``(block, term, df, places, slices)``, sorted by term in each block.

    A block is closed at about ``block_docs`` documents (65,536 at most) or ``block_postings`` pairs of term and document.
    """
    if block_docs > 1 << 16:
        raise ValueError("a block has at most 65,536 documents")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    index = written(rows.mapInArrow(_slim(block_docs, _indexed(size["docs"], max(1, size["terms"]), block_docs, block_postings)), _SQL), "lexical-index", compression="zstd")
    index._n_docs = size["docs"]
    return index


def _slim(most: int, run):
    """``run`` on batches of at most ``most`` rows, so that no slice is more than a block."""

    def slim(batches):
        yield from run(b.slice(at, most) for b in batches for at in range(0, b.num_rows, most))

    return slim


def _spread(blob: np.ndarray, places: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps over a term's documents as bitmaps over the block's."""
    bits = np.zeros((len(blob), 64 * words), np.uint8)
    bits[:, places] = np.unpackbits(blob, axis=1, count=len(places))
    return np.packbits(bits, axis=1).view(np.uint64)


def _times(slices: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Bit-sliced numbers ``(bits, words)`` times a number for each word, by shifting and adding with carry."""
    bits, words = slices.shape
    top = int(by.max()).bit_length() if len(by) else 0
    out = np.zeros((bits + top, words), slices.dtype)
    for shift in range(top):
        mask = -(by >> shift & 1).astype(slices.dtype)
        carry = np.zeros(words, slices.dtype)
        for s in range(bits):
            x, y = out[shift + s], slices[s] & mask
            half = x ^ y
            out[shift + s], carry = half ^ carry, (x & y) | (half & carry)
        for s in range(shift + bits, bits + top):
            out[s], carry = out[s] ^ carry, out[s] & carry
    return out


def _summed(spread: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Sums of bit-sliced numbers ``spread[list]`` for each list, longest first: ``(bits, lists, words)``."""
    rounds = len(lists[0])
    bits = spread.shape[1]
    out = np.zeros((bits + rounds.bit_length(), len(lists), spread.shape[2]), np.uint64)
    for r in range(rounds):
        own = np.array([x[r] for x in lists if len(x) > r])
        n, carry = len(own), np.zeros((len(own), spread.shape[2]), np.uint64)
        for s in range(bits):
            x, y = out[s, :n], spread[own, s]
            half = x ^ y
            both = x & y
            out[s, :n] = half ^ carry
            carry = both | (half & carry)
        for s in range(bits, len(out)):
            x = out[s, :n].copy()
            out[s, :n] = x ^ carry
            carry &= x
    return out


def _best(sums: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the ``k`` largest of ``n`` bit-sliced numbers, of equal ones the first."""
    taken = np.zeros(sums.shape[1], np.uint64)
    open_ = np.packbits(np.arange(64 * sums.shape[1]) < n).view(np.uint64)
    have = 0  # how many are taken
    for bits in sums[::-1]:
        more = open_ & bits
        count = int(np.bitwise_count(more).sum())
        if have + count > k:
            open_ = more
        else:
            taken, have = taken | more, have + count
            open_ = open_ & ~bits
            if have == k:
                break
    rest = np.flatnonzero(np.unpackbits(open_.view(np.uint8)))[: k - have]
    return np.concatenate([np.flatnonzero(np.unpackbits(taken.view(np.uint8))), rest])


def _values(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(sums).view(np.uint8), axis=1)[:, at].astype(np.int64)
    return (bits << np.arange(len(sums))[:, None]).sum(axis=0)


def _searched(queries: list[list[tuple[int, int]]], weights: dict[int, int], k: int):
    """Of a block's rows the best documents of each query: ``queries`` list a query's terms, by number, with their repeats."""

    def run(rows: pa.Table) -> pa.Table:
        term, size = rows["number"].to_numpy(), rows["df"].to_numpy()
        own = int(np.flatnonzero(term < 0)[0])
        n, none = int(size[own]), int.from_bytes(rows["slices"][own].as_py(), "little")
        ids = np.frombuffer(rows["places"][own].as_py(), np.int64)
        words = -(-n // 64)
        at = {t: k for k, t in enumerate(term.tolist()) if t >= 0}
        asked = [[(at[t], r * weights[t]) for t, r in q if t in at and weights[t]] for q in queries]
        order = sorted((x for x in range(len(asked)) if asked[x]), key=lambda x: -len(asked[x]))
        places, slices = (flat(rows[c]) for c in ("places", "slices"))
        out = []
        while order:
            pairs, few = {}, []  # as many queries as the spread bitmaps of their terms let
            for x in order:
                new = [p for p in asked[x] if p not in pairs]
                if few and (len(pairs) + len(new)) * 8 * words * (SLICES + 20) > SPREAD_BYTES:
                    break
                few.append(x)
                pairs.update(zip(new, range(len(pairs), len(pairs) + len(new))))
            order = order[len(few) :]
            blobs = [slices[0][slices[1][row] : slices[1][row + 1]].reshape(SLICES, -1) for row, _ in pairs]
            widths = [b.shape[1] for b in blobs]
            grown = _times(np.concatenate(blobs, axis=1), np.repeat(np.array([w for _, w in pairs], np.int64), widths))
            edges = np.concatenate([[0], np.cumsum(widths)])
            spread = np.stack([_spread(grown[:, edges[x] : edges[x + 1]], places[0][places[1][row] : places[1][row + 1]].view(np.uint16), words) for x, (row, _) in enumerate(pairs)])
            sums = _summed(spread, [np.array([pairs[p] for p in asked[x]]) for x in few])
            for nth, x in enumerate(few):
                best = _best(sums[:, nth], n, k)
                score = _values(sums[:, nth], best)
                best, score = best[score > 0], score[score > 0]
                out.append(pa.table({"item": np.full(len(best), x), "doc_id": pa.array(ids[best], mask=best >= n - none), "score": score}))
        return pa.concat_tables(out) if out else pa.table({"item": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    return run


def _terms_of(text: str | None) -> Counter:
    raw = (text or "").encode()
    starts, ends, _ = spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    return Counter(raw[a:b].translate(_LOWER).decode() for a, b in zip(starts.tolist(), ends.tolist()))


_LOWER = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))


def _search_some(index: DataFrame, items: list[tuple], kind, k: int) -> DataFrame:
    """The best of each block for some queries ``(item_id, terms)``."""
    spark = index.sparkSession
    names = sorted({t for _, terms in items for t in terms})
    number = {t: x for x, t in enumerate(names)}
    asked = F.broadcast(spark.createDataFrame([(x, t) for x, t in enumerate(names)], "number long, term string"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * index._n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    counts = index.select("term", "df").join(asked, "term").groupBy("number").agg(F.sum("df").alias("df"))
    weights = {r["number"]: r["weight"] for r in counts.select("number", weight.alias("weight")).collect()}
    rows = index.join(asked, "term").select("block", "number", "df", "places", "slices")
    rows = rows.unionByName(index.where("term IS NULL").select("block", F.lit(-1).cast("long").alias("number"), "df", "places", "slices"))
    queries = [[(number[t], r) for t, r in terms.items()] for _, terms in items]
    found = rows.groupBy("block").applyInArrow(_searched(queries, weights, k), "item long, doc_id long, score long")
    about = spark.createDataFrame([(x, i) for x, (i, _) in enumerate(items)], f"item long, item_id {kind}")
    return found.join(F.broadcast(about), "item")


def search(index: DataFrame, items: DataFrame, k: int = K, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``k`` best documents of each row of ``items`` (``item_id``, ``text``): ``(item_id, rank, doc_id, score)``.

    Queries are taken in lots of about ``query_terms`` different terms each, which the driver holds while a lot is searched.
    """
    kind, parts, lot, held = items.schema["item_id"].dataType.simpleString(), [], [], 0

    def done():
        parts.append(written(_search_some(index, lot, kind, k).withColumn("lot", F.lit(len(parts))).hint("rebalance"), "lexical-hits"))  # few files

    for row in items.select("item_id", "text").toLocalIterator():
        lot.append((row["item_id"], _terms_of(row["text"])))
        held += len(lot[-1][1])
        if held >= query_terms:
            done()
            lot, held = [], 0
    done()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("lot", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``k`` highest-scoring of all ``docs`` (``doc_id``, ``text``) for each row of ``items`` (``item_id``, ``text``).

    Terms are runs of 0-9, A-Z, a-z and characters beyond 0x7F, A-Z lower-cased. Of ``N`` documents with a term, ``L`` terms in all and
    ``df`` documents with a term, its weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document of ``n`` terms has ``m = 25 + (75 n N) div L``
    and scores ``weight * ((1000000000 tf) div (1000 tf + 8 m))`` for each of the item's terms, repeats included. Returns ``item_id``, ``rank``
    from 1, ``doc_id`` and ``score``, only scores above 0; of equal ones the smaller ``doc_id`` comes first, none last. Every row of
    either side counts for itself, whether ids are repeated or null. A null or empty text has no term. No documents or items: no rows. Long texts are
    counted in pieces; a document's different terms are held together. The index is removed when the search is done.
    """
    index = build_index(docs, block_docs, block_postings)
    out = search(index, items, k, query_terms)
    deleted(index)
    return out

