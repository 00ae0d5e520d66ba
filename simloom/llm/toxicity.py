"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words (0-9, a-z and bytes above 0x7F, A-Z lower-cased) and their
beginnings of 4, 5 and 6 bytes, as 64-bit hashes. The model is ``b + sum w_i + sum <v_i, v_j>`` over
the terms present, so that pairs such as an insult with a group mention count beyond their own
weights. It is fitted by AdaGrad on a bounded, stratified sample of labelled rows on the driver, which
sees a random part of each row's terms at a time, so that one term alone comes to tell too. ``b`` is
that of the classes' shares among all labelled rows, whatever those of the sample are. Every row is
scored on the executors with the broadcast model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, flat, in_slices, plain_names, written
from .words import ALNUM, hashed, mix, spans

#: Most labelled rows of each class that the model is fitted on, those of least hash.
SAMPLE = {1: 4000, 0: 6000}
BEGINNINGS = (4, 5, 6)
#: A term counts if this many sampled rows have it, and its shares of the two classes differ by this
#: many standard errors: else chance words of few rows outweigh those that tell. The most telling
#: ``MOST_TERMS`` are the model's.
LEAST_DOCUMENTS, LEAST_LEAN, MOST_TERMS = 3, 4.0, 200_000
#: Of the ``PAIR_TERMS`` terms that stand in most sampled rows each two are tried: both count, whatever each
#: is alone, if the rows that have both lean by ``LEAST_PAIR_LEAN`` and by ``PAIR_GAIN`` more than either alone.
PAIR_TERMS, LEAST_PAIR_LEAN, PAIR_GAIN = 4096, 6.0, 2.0


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and beginning, with the number of its text; not yet distinct."""
    starts, ends, first = spans(data, offsets, ALNUM)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, owners = [hashed(data, starts, ends)], [text]
    for size in BEGINNINGS:
        longer = ends - starts > size
        hashes.append(mix(hashed(data, starts[longer], starts[longer] + size) + np.uint64(size)))
        owners.append(text[longer])
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class FactorizationMachine:
    known: np.ndarray  # sorted hashes of the terms
    bias: float
    weight: np.ndarray
    factors: np.ndarray
    sieve: np.ndarray

    def raw(self, rows: np.ndarray, terms_at: np.ndarray, n: int) -> np.ndarray:
        y = np.full(n, self.bias) + np.bincount(rows, self.weight[terms_at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[terms_at, f]
            y += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return y

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        hashes, rows = terms(data, offsets)
        maybe = self.sieve[(hashes >> np.uint64(42)).astype(np.int64)]
        hashes, rows = hashes[maybe], rows[maybe]
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        found = self.known[at] == hashes if len(self.known) else np.zeros(0, bool)
        pairs = np.unique(rows[found] * np.int64(max(1, len(self.known))) + at[found])
        rows, at = np.divmod(pairs, max(1, len(self.known)))
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, at, n), -30, 30)))


def fit(known: np.ndarray, documents: list[np.ndarray], labels: np.ndarray, odds: float | None = None, rank: int = 4, epochs: int = 12, rate: float = 0.1, penalty: float = 1e-4, least_shown: float = 0.6, seed: int = 7) -> FactorizationMachine:
    """``known``: sorted hashes of the terms that count; ``documents``: places in it of each row's terms.

    A row shows from ``least_shown`` to all of its terms at a time. ``odds`` are those of label 1 among
    all labelled rows, if the rows given have others. Rows of one class only, or none, give a
    constant score.
    """
    rng = np.random.default_rng(seed)
    rows = np.repeat(np.arange(len(documents)), [len(x) for x in documents])
    at = np.concatenate([np.zeros(0, np.int64), *documents])
    edges = np.searchsorted(rows, np.arange(len(documents) + 1))
    sieve = np.zeros(1 << 22, bool)
    sieve[(known >> np.uint64(42)).astype(np.int64)] = True
    rate_of_ones = (labels.sum() + 0.5) / (len(labels) + 1)
    model = FactorizationMachine(known, float(np.log(rate_of_ones / (1 - rate_of_ones))), np.zeros(len(known)), rng.normal(0, 0.01, (len(known), rank)), sieve)
    if len(np.unique(labels)) < 2:
        return model
    squares = np.full((len(known), rank + 1), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for k in range(0, len(order), 128):
            batch = order[k : k + 128]
            spots = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in batch])
            r = np.repeat(np.arange(len(batch)), edges[batch + 1] - edges[batch])
            shown = rng.random(len(r)) < rng.uniform(least_shown, 1, len(batch))[r]
            t, r = at[spots[shown]], r[shown]
            own, place = np.unique(t, return_inverse=True)
            y = model.raw(r, t, len(batch))
            slope = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[batch]) / len(batch)
            steps = [np.bincount(place, slope[r], len(own)) + penalty * model.weight[own]]
            for f in range(rank):
                v = model.factors[t, f]
                steps.append(np.bincount(place, slope[r] * (np.bincount(r, v, len(batch))[r] - v), len(own)) + penalty * model.factors[own, f])
            step = np.stack(steps, 1)
            squares[own] += step**2
            step *= rate / np.sqrt(squares[own])
            model.weight[own] -= step[:, 0]
            model.factors[own] -= 0.3 * step[:, 1:]
    if odds:
        model.bias = float(np.log(odds))
    return model


def _distinct(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of each text of a slice, by text."""
    hashes, rows = terms(*flat(part.column(part.schema.get_field_index("text"))))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new]


def _term_counts(batches):
    """In how many texts of a slice, and of its toxic ones, each term stands."""
    for part in in_slices(batches):
        hashes, rows = _distinct(part)
        values, place, times = np.unique(hashes, return_inverse=True, return_counts=True)
        ones = np.bincount(place, part.column(part.schema.get_field_index("toxic")).to_numpy()[rows], len(values))
        yield pa.record_batch({"term": values.view(np.int64), "n": times.astype(np.int64), "ones": ones.astype(np.int64)})


def paired(documents: list[np.ndarray], labels: np.ndarray, n: int, tile: int = 256) -> np.ndarray:
    """Places, of the ``n`` that ``documents`` refer to, of terms that tell together with another one, whatever each tells alone.

    Rows that have both terms are counted for ``tile`` terms with all others at a time, out of one byte
    for each row and term.
    """
    has = np.zeros((len(documents), n), np.uint8)
    for row, places in enumerate(documents):
        has[row, places] = 1
    own = [np.flatnonzero(labels == kind) for kind in (0, 1)]
    n0, n1 = (max(1, len(x)) for x in own)

    def lean(zeros, ones):
        share = (zeros + ones) / (n0 + n1)
        return np.abs(ones / n1 - zeros / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))

    alone, found = lean(*(has[x].sum(0, dtype=np.float32) for x in own)), np.zeros(n, bool)
    for k in range(0, n, tile):
        rows = slice(k, k + tile)
        both = [np.zeros((len(alone[rows]), n), np.float32) for _ in own]
        for kind in (0, 1):
            for at in range(0, len(own[kind]), 500):
                part = has[own[kind][at : at + 500]].astype(np.float32)
                both[kind] += part[:, rows].T @ part
        tells = lean(*both)
        tells = (tells >= LEAST_PAIR_LEAN) & (tells >= np.maximum(alone[rows, None], alone) + PAIR_GAIN) & (both[0] + both[1] >= LEAST_DOCUMENTS)
        found[rows] |= tells.any(1)
    return np.flatnonzero(found)


def _sample_terms(shared):
    def run(batches):
        known = shared.value
        for part in in_slices(batches):
            hashes, rows = _distinct(part)
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            found = known[at] == hashes if len(known) else np.zeros(0, bool)
            at, edges = at[found], np.searchsorted(rows[found], np.arange(part.num_rows + 1))
            yield pa.record_batch([part.column(0), part.column(1), pa.array([at[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["doc_id", "toxic", "terms"])

    return run


def fold(divisor: int, at: int):
    """Whether crc32 of ``doc_id`` as text has the remainder ``at``; a null ``doc_id`` counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == at, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> FactorizationMachine:
    """Fit on at most ``sample[c]`` labelled rows of class ``c`` that are not held out, those of least hash of ``doc_id``.

    Null labels and ids are not used; of several labels of a ``doc_id`` the largest counts. Counts of
    terms are summed on the executors; only the terms that tell and the ``PAIR_TERMS`` commonest reach the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~fold(5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for kind, most in sorted(sample.items()):
        part = usable.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = written(chosen, "toxicity-sample")
    all_of = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), "toxicity-rows")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    known = np.zeros(0, np.uint64)
    if n1 and n0:
        counts = rows.mapInArrow(_term_counts, "term long, n long, ones long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
        share = F.col("n") / (n1 + n0)
        lean = (F.col("ones") / n1 - (F.col("n") - F.col("ones")) / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0))
        telling = counts.where(F.col("n") >= LEAST_DOCUMENTS).withColumn("lean", F.abs(lean)).where(F.col("lean") >= LEAST_LEAN)
        found = telling.orderBy(F.desc("lean"), "term").limit(MOST_TERMS).select("term").toArrow()
        known = found["term"].to_numpy().view(np.uint64)
        common = counts.where(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "term").limit(PAIR_TERMS).select("term").toArrow()
        common = np.sort(common["term"].to_numpy().view(np.uint64))
        known = np.union1d(known, common[paired(*_places(rows, common), len(common))])
    model = fit(known, *_places(rows, known), odds=all_of[1] / all_of[0] if n1 and n0 else None)
    deleted(chosen, rows)
    return model


def _places(rows: DataFrame, known: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each row the places of its terms in ``known``, and the labels."""
    table = rows.mapInArrow(_sample_terms(rows.sparkSession.sparkContext.broadcast(known)), "doc_id long, toxic int, terms binary").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    return [np.frombuffer(x, np.int32).astype(np.int64) for x in table["terms"].to_pylist()], table["toxic"].to_numpy().astype(float)


def _score(shared, keep: bool):
    def run(batches):
        for part in in_slices(batches):
            score = shared.value.score(*flat(part.column(part.schema.get_field_index("text"))))
            if keep:
                yield part.filter(pa.array(score < 0.5))
            else:
                yield pa.record_batch([part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """Score every text of ``docs`` for toxicity, as ``labels.toxic`` marks it.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and ``toxic``; other columns
    are not read. Rows whose crc32 of ``doc_id`` as text is divisible by 5 are held out from
    fitting. Returns ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on),
    one row per row. A null or empty text has the score of no terms. Without labels of both classes
    every text has the same score. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long"), fold(5, 0).alias("held_out"), "text")
    return rows.mapInArrow(_score(shared, False), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    rows = plain_names(docs, "text")
    return rows.mapInArrow(_score(shared, True), rows.schema).toDF(*docs.columns)
