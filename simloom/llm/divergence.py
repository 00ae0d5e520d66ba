"""How the sources of a language differ in the terms they use: sketch-prefiltered exact counts, then sparse pair joins.

1. Each task adds the document counts of its terms to a count-min sketch of ``(lang, term)``, saturated at the least
   count that matters. Sketches are added up segment by segment. A sum is never less than the true count.
2. Tasks count occurrences and documents of each term in each ``(lang, source)``, block by block. Terms whose sum is too
   small in any of the sketch's rows are impossible and dropped there, before any shuffle; the others are counted exactly.
3. Sources of a language are put to tiles, its terms to buckets. A tile's counts in a bucket are one sparse
   row; each two tiles meet in an equi-join on language and bucket and give one number for each pair of
   their sources. Sums over the buckets are the distances.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, packed, unpacked, written
from .terms import Names, counted, whole
from .words import mix

LEAST, TOP = 30, 50
ONE, PRIOR = 1_000_000_000, 5
#: Pairs of document and term that a task counts together.
BLOCK = 1 << 21
#: Rows of the sketch; counters of a row at least and at most; counters of a segment.
DEPTH, LEAST_WIDTH, MOST_WIDTH, SEGMENT = 4, 1 << 16, 1 << 23, 1 << 16
#: Counters for each document.
PER_DOCUMENT = 256
#: Sources of a tile, terms of a bucket.
TILE, BUCKET = 64, 4096
_ROWS = 1 << 16

_BYTE = np.arange(256)
LETTERS = ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_COUNTS = pa.schema([("g", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTS_SQL = "g long, term string, n long, docs long"


def _keys(rows: pa.RecordBatch, text: np.ndarray, term: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's language with each of its terms; the language's hash is the first column."""
    return mix(rows.column(0).to_numpy().view(np.uint64)[text] * np.uint64(0x9E3779B97F4A7C15) ^ term)


def _counted(block: int, bits: np.ndarray):
    def flush(found: list, names: Names):
        group, term, n = map(np.concatenate, zip(*found))
        groups, group = np.unique(group, return_inverse=True)
        hashes, strings = names.all()
        keys, at = np.unique(group * max(1, len(hashes)) + np.searchsorted(hashes, term), return_inverse=True)
        sums, docs = np.bincount(at, n, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
        group, term = np.divmod(keys, max(1, len(hashes)))
        for a in range(0, len(keys), _ROWS):
            yield pa.record_batch([pa.array(groups[group[a : a + _ROWS]]), strings.take(pa.array(term[a : a + _ROWS])), pa.array(sums[a : a + _ROWS]), pa.array(docs[a : a + _ROWS])], schema=_COUNTS)

    def run(batches):
        found, names, held = [], Names(), 0
        for rows, text, term, n, (hashes, strings) in whole(counted(batches, LETTERS)):
            keep = reaches(_keys(rows, text, term), bits)
            text, term, n = text[keep], term[keep], n[keep]
            left = np.isin(hashes, term)
            names.add((hashes[left], strings.filter(pa.array(left))))
            found.append((rows.column(1).to_numpy()[text], term, n))
            held += len(term)
            if held >= block:
                yield from flush(found, names)
                found, names, held = [], Names(), 0
        if held:
            yield from flush(found, names)

    return run


def _places(hashes: np.ndarray, width: int, row: int) -> np.ndarray:
    """A counter of each hash in a row of the sketch."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return ((low + np.uint64(row) * high) & np.uint64(width - 1)).astype(np.int64)


def reaches(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether all counters of each hash reach the least count."""
    keep = np.ones(len(hashes), bool)
    for row in range(DEPTH):
        at = _places(hashes, 8 * bits.shape[1], row)
        keep &= (bits[row, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


class Sketch:
    """Counters that stop at ``least``; at most some ten thousand are added at once."""

    def __init__(self, width: int, least: int):
        self.least = least
        self.counters = np.zeros((DEPTH, width), np.uint16 if least < 1 << 15 else np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        for row, counters in enumerate(self.counters):
            places = _places(hashes, len(counters), row)
            np.add.at(counters, places, 1)
            counters[places] = np.minimum(counters[places], self.least)

    def segments(self):
        """``(row, segment, counters)``, but for empty ones."""
        for row, counters in enumerate(self.counters):
            for k, segment in enumerate(counters.reshape(-1, SEGMENT)):
                if segment.any():
                    yield row, k, packed(segment)


def _sketched(width: int, least: int):
    def run(batches):
        from pyspark import TaskContext

        sketch = Sketch(width, least)
        for rows, text, term, _, _ in whole(counted(batches, LETTERS)):
            sketch.add(_keys(rows, text, term))
        for row, k, counters in sketch.segments():
            yield pa.record_batch([[row], [k], [TaskContext.get().partitionId()], [counters]], names=["row", "segment", "task", "counters"])

    return run


def _added(least: int):
    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(SEGMENT, np.int64)
        for raw in rows["counters"]:
            total = np.minimum(total + unpacked(raw.as_py()), least)
        return pa.table({"row": rows["row"][:1], "segment": rows["segment"][:1], "counters": [packed(total.astype(np.uint32))]})

    return run


def possible_terms(texts: DataFrame, least: int, width: int) -> np.ndarray:
    """Bits ``(DEPTH, width / 8)`` of the counters of the merged sketch that reach ``least``.

    ``texts``: ``(lang_hash, g, text)``. Of sketches, one for each task, segments are added up in two steps, 256 tasks' in the
    first, one for every 256 tasks in the second. The driver gets one bit for each counter, 4 MB at most.
    """
    kind = "row long, segment long, counters binary"
    parts = texts.mapInArrow(_sketched(width, least), "row long, segment long, task long, counters binary")
    some = parts.groupBy("row", "segment", F.expr("task DIV 256")).applyInArrow(_added(least), kind)
    out = np.zeros((DEPTH, width // 8), np.uint8)
    for r in some.groupBy("row", "segment").applyInArrow(_reached(least), kind).toLocalIterator():
        out[r["row"], r["segment"] * SEGMENT // 8 : (r["segment"] + 1) * SEGMENT // 8] = unpacked(r["counters"])
    return out


def _reached(least: int):
    def run(rows: pa.Table) -> pa.Table:
        (total,) = _added(least)(rows)["counters"].to_pylist()
        return pa.table({"row": rows["row"][:1], "segment": rows["segment"][:1], "counters": [packed(np.packbits(unpacked(total) >= least))]})

    return run


def _share(n: Column, whole_n: Column, terms: Column) -> Column:
    """``1 + floor(ONE (n + PRIOR) / (whole + PRIOR terms))``; decimals hold products that a long would not."""
    over = F.lit(ONE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(19,0)")
    below = (whole_n + PRIOR * terms).cast("decimal(19,0)")
    return F.when(terms > 0, F.call_function("div", over, below) + 1).otherwise(F.lit(0)).cast("long")


def _distances(rows):
    """Of each two tiles in a bucket, the summed distance of each two sources, the first one's number being smaller."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64())])

    def dense(batch, side, k, columns):
        heads, entries = batch.column(f"{side}_head"), batch.column(f"{side}_entries")
        head = heads[k].values
        out = np.repeat(head.field("p0").to_numpy()[:, None], columns, axis=1)
        first = head.field("no")[0].as_py()
        if entries[k].is_valid:
            no, col, p = (entries[k].values.field(c).to_numpy() for c in ("no", "col", "p"))
            out[no - first, col] = p
        return first, out

    for batch in rows:
        for k in range(batch.num_rows):
            columns = batch.column("columns")[k].as_py()
            (i, x), (j, y) = (dense(batch, side, k, columns) for side in ("a", "b"))
            sums = np.array([np.abs(y - own).sum(axis=1) for own in x])
            a, b = (v.ravel() for v in np.meshgrid(i + np.arange(len(x)), j + np.arange(len(y)), indexing="ij"))
            use = a < b
            yield pa.record_batch([pa.array([batch.column("lang")[k].as_py()] * int(use.sum()), pa.string()), pa.array(a[use]), pa.array(b[use]), pa.array(sums.ravel()[use])], schema=schema)


def _pair_distances(terms: DataFrame, groups: DataFrame, kept: DataFrame, langs: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of each two sources of a language, both ways."""
    heads = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("no", "p0"))).alias("head"))
    columns = kept.groupBy("lang", "bucket").agg(F.count("*").cast("int").alias("columns"))
    entries = terms.groupBy("lang", "tile", "bucket").agg(F.collect_list(F.struct("no", "col", "p")).alias("entries"))
    rows = heads.join(langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket")), "lang")
    rows = written(rows.join(columns, ["lang", "bucket"], "left").join(entries, ["lang", "tile", "bucket"], "left").withColumn("columns", F.coalesce("columns", F.lit(0))), "divergence-tiles")
    a = rows.select("lang", "bucket", "columns", F.col("tile").alias("i"), F.col("head").alias("a_head"), F.col("entries").alias("a_entries"))
    b = rows.select("lang", "bucket", F.col("tile").alias("j"), F.col("head").alias("b_head"), F.col("entries").alias("b_entries"))
    tiles = a.join(b, ["lang", "bucket"]).where("i <= j").select("lang", "columns", "a_head", "a_entries", "b_head", "b_entries")
    sums = tiles.mapInArrow(_distances, "lang string, a long, b long, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("no"), F.col("b").alias("other")), F.struct(F.col("b").alias("no"), F.col("a").alias("other")))).alias("x"), "value").select("lang", "x.*", "value")
    names = groups.select("lang", "no", "source")
    named = both.join(names, ["lang", "no"]).join(names.select("lang", F.col("no").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    out = written(named.select("lang", "source", "item", "value"), "divergence-pairs")
    deleted(rows)
    return out


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """How far each source's terms are from those of the other sources of its language, and which of its terms stand out.

    ``docs`` needs ``text``, ``lang`` and ``source``, null counting as empty; other columns are not read. Terms are runs of A-Z, a-z and
    characters beyond 0x7F, A-Z lower-cased; those in at least ``least`` of a language's documents count, ``V`` of them.
    With ``N`` occurrences of such terms in a source of a language, or in the whole language, a term that occurs ``n`` times there
    has the share ``1 + floor(10**9 (n + 5) / (N + 5 V))``. Returns ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: in
    part "pair" every other source of the language with the summed difference of all terms' shares, in part "term" the terms
    that the source has and whose share is above the language's, by that difference, ranks up to ``top``; equal values in the
    order of ``item``. A source without terms, or of a language of which no term counts, is a source still; then values of pairs
    are 0. Repeated rows count each; no rows: no rows. Long texts are counted in pieces; a text's different terms are held together.
    """
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    texts = rows.select(F.xxhash64("lang").alias("lang_hash"), F.xxhash64("lang", "source").alias("g"), "text")
    named = written(rows.groupBy("lang", "source").agg(F.count("*").alias("size")).withColumn("g", F.xxhash64("lang", "source")), "divergence-groups")
    size = named.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("docs"), F.count("g").alias("n"), F.count_distinct("g").alias("different")).first()
    if size["n"] != size["different"]:
        raise ValueError("two groups of one 64-bit hash")
    width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << math.ceil(math.log2(PER_DOCUMENT * max(1, size["docs"])))))
    bits = possible_terms(texts, least, width)
    exact = texts.mapInArrow(_counted(block, bits), _COUNTS_SQL).groupBy("g", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    exact = written(exact.join(named.select("g", "lang"), "g"), "divergence-exact")
    kept = exact.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = written(kept.select("lang", "term", "lang_n"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("whole"))
    langs = named.select("lang").distinct().join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("whole", F.lit(0)).alias("whole"))
    langs = written(langs.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("v") / bucket)).cast("long")), "divergence-langs")
    in_bucket = Window.partitionBy("lang", "bucket").orderBy("term")
    placed = kept.join(langs, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets"))
    placed = written(placed.select("lang", "term", "bucket", (F.row_number().over(in_bucket) - 1).alias("col"), _share(F.col("lang_n"), F.col("whole"), F.col("v")).alias("q")), "divergence-terms")
    own = exact.select("lang", "g", "term", "n").join(placed, ["lang", "term"])
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = named.join(own.groupBy("g").agg(F.sum("n").alias("own_n")), "g", "left").join(langs.select("lang", "v"), "lang")
    groups = groups.select("lang", "source", "g", "v", F.coalesce("own_n", F.lit(0)).alias("own_n"), number.alias("no"))
    groups = written(groups.withColumns({"tile": F.expr(f"no DIV {tile}"), "p0": _share(F.lit(0).cast("long"), F.col("own_n"), F.col("v"))}), "divergence-sources")
    terms = own.drop("lang").join(groups.drop("p0"), "g").select("lang", "source", "term", "tile", "no", "bucket", "col", "q", _share(F.col("n"), F.col("own_n"), F.col("v")).alias("p"))
    terms = written(terms, "divergence-shares")
    pairs = _pair_distances(terms, groups, placed, langs)
    ranks = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    lead = terms.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    lead = written(lead.withColumn("rank", ranks()).where(F.col("rank") <= top), "divergence-lead")
    deleted(exact, kept, named, langs, placed, groups, terms)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranks())
    return pairs.unionByName(lead)
