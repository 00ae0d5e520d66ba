"""N-gram Jaccard join by prefix trees.

Method, for documents as sets of hashed 5-word shingles and a similarity of 0.75 or more:

1. ``_send``: blocks of about a million shingles send their sorted shingles, cut to 48 bits, to
   owners by value. A shingle that 64 or more sets of a block hold is sent once with its count;
   its list stays in the written block.
2. ``_count``: an owner counts over all blocks in how many sets each shingle stands, and replies
   with the counts of those in two or more. That makes the common order: rarest first.
3. ``_prefixes``: a block puts the shingles of each set into that order. Of two sets that reach
   the similarity, the first ``n - ceil(0.75 n) + 1`` shingles of each have one in common. A set
   with so many shingles of its own has no partner and is done. Others send what is left of their
   prefix, once for each block and shingle, to owners again.
4. ``_meet``: sets that meet there are candidates. Components of candidates are small, as only
   rare shingles make them; they are found by ``components``.
5. ``_join``: the whole sets of a candidate component go to one task, which stores them in a
   prefix tree and joins them exactly (``trie``). A component beyond ``most_shingles`` is cut to
   chunks by hash. Each chunk is joined with itself and the first one, which unites near copies.
   Sets outside the largest part then are queries, in blocks, against all chunks; links between
   sets of that part can't change a result. That is linear in the chunks for each query block.

Cutting to 48 bits and counts of equal sets in several blocks only add candidates. No link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deleted, flat, in_slices, packed, partitions, texts, unpacked, written
from .components import components
from .trie import linked
from .words import shingle_sets

BLOCK = 1_000_000
HEAVY = 64
CHUNK = 4_000_000
#: Most candidate sets whose (hash, component) pairs are broadcast: 16 MB. Beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_SENT = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("sig", pa.int64()), ("again", pa.int64()), ("block", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("sigs", "sizes", "tokens", "reps", "heavy", "counts", "lists"))])
_SENT_SQL = "kind int, doc_id long, key binary, n long, sig long, again long, block long, bucket int, sigs binary, sizes binary, tokens binary, reps binary, heavy binary, counts binary, lists binary"
_REPLY_SQL = "block long, tokens binary, reps binary, counts binary, heavy binary, lists binary"
_MET_SQL = "bucket int, tokens binary, sigs binary, src binary, dst binary"


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted 48-bit values as differences of four bytes, or of eight where one is larger; planes of bytes, compressed."""
    steps = np.diff(x)
    if len(steps) and int(steps.max()) < 1 << 32:
        return b"4" + x[:1].tobytes() + packed(steps.astype(np.uint32))
    return b"8" + packed(x)


def _spread(raw: bytes) -> np.ndarray:
    if raw[:1] == b"4":
        steps = unpacked(raw[9:])
        out = np.empty(len(steps) + 1, np.uint64)
        out[0] = np.frombuffer(raw, np.uint64, 1, 1)[0]
        out[1:] = steps
        return np.cumsum(out, dtype=np.uint64)
    return unpacked(raw[1:])


def _narrow(reps: np.ndarray) -> bytes:
    """Places of sets in a block: two bytes each, or four where a block has more than 65,536 sets."""
    return packed(reps.astype(np.uint16 if not len(reps) or int(reps.max()) < 1 << 16 else np.uint32))


def _wide(raw: bytes) -> np.ndarray:
    return unpacked(raw).astype(np.int32)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_values)))


def signatures(shingles: np.ndarray, salt: int) -> tuple[int, int]:
    """What names a set, and 64 bits more by which two sets of one name are told apart."""
    both = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(both[:8], "little", signed=True), int.from_bytes(both[8:], "little", signed=True)


def _bucket_edges(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    number = ((tokens >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
    starts, _ = _runs(number)
    return number[starts].astype(np.int32), np.append(starts, len(tokens))


def _send(buckets: int, salt: int):
    def flush(block: int, sigs: list[int], sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets], np.int64)
        yield {"kind": 2, "block": block, "sigs": np.array(sigs, np.int64).tobytes(), "sizes": sizes.astype(np.int32).tobytes()}
        tokens = np.concatenate(sets) >> np.uint64(16)
        reps = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, reps = tokens[order], reps[order]
        names, edges = _bucket_edges(tokens, buckets)
        for name, a, b in zip(names.tolist(), edges[:-1].tolist(), edges[1:].tolist()):
            t, r = tokens[a:b], reps[a:b]
            starts, lengths = _runs(t)
            many = lengths >= HEAVY
            heavy = np.repeat(many, lengths)
            yield {"kind": 1, "block": block, "bucket": name, "tokens": _squeeze(t[~heavy]), "reps": _narrow(r[~heavy]), "heavy": t[starts[many]].tobytes(), "counts": lengths[many].astype(np.int32).tobytes(), "lists": _narrow(r[heavy])}

    def run(batches):
        from pyspark import TaskContext

        block, seen, sigs, sets, held = TaskContext.get().partitionId() << 24, set(), [], [], 0
        for part in in_slices(batches):
            found = shingle_sets(*flat(part.column(1)))
            own, again = zip(*(signatures(x, salt) if len(x) else (None, None) for x in found))
            yield pa.record_batch({"kind": np.zeros(len(own), np.int32), "doc_id": part.column(0).cast(pa.int64()), "key": part.column(2), "n": np.array([len(x) for x in found], np.int64), "sig": pa.array(own, pa.int64()), "again": pa.array(again, pa.int64()), **{c: pa.nulls(len(own), _SENT.field(c).type) for c in _SENT.names[6:]}}, schema=_SENT)
            for sig, x in zip(own, found):
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    sigs.append(sig)
                    sets.append(x)
                    held += len(x)
                    if held >= BLOCK:
                        yield from (pa.RecordBatch.from_pylist([row], _SENT) for row in flush(block, sigs, sets))
                        block, seen, sigs, sets, held = block + 1, set(), [], [], 0
        if sets:
            yield from (pa.RecordBatch.from_pylist([row], _SENT) for row in flush(block, sigs, sets))

    return run


def _count(table: pa.Table) -> pa.Table:
    blocks = table["block"].to_pylist()
    tokens = [_spread(x) for x in texts(table["tokens"])]
    reps = [_wide(x) for x in texts(table["reps"])]
    heavy = [np.frombuffer(x, np.uint64) for x in texts(table["heavy"])]
    counts = [np.frombuffer(x, np.int32) for x in texts(table["counts"])]
    every = np.sort(np.concatenate(tokens))
    starts, lengths = _runs(every)
    light, many = every[starts], np.unique(np.concatenate(heavy))
    total = dict(zip(many.tolist(), [0] * len(many)))
    for t, c in zip(heavy, counts):
        for key, n in zip(t.tolist(), c.tolist()):
            total[key] += n
    if len(many):
        place = np.searchsorted(light, many)
        there = (place < len(light)) & (light[np.minimum(place, len(light) - 1)] == many) if len(light) else np.zeros(len(many), bool)
        extra = np.fromiter(total.values(), np.int64, len(many))
        lengths[place[there]] += extra[there]
        extra[there] = lengths[place[there]]
        total = dict(zip(many.tolist(), extra.tolist()))
    more = lengths >= 2
    shared, times = light[more], lengths[more]
    out = []
    for block, t, r, h in zip(blocks, tokens, reps, heavy):
        place = np.searchsorted(shared, t)
        keep = np.flatnonzero((place < len(shared)) & (shared[np.minimum(place, len(shared) - 1)] == t)) if len(shared) else np.zeros(0, np.int64)
        if len(keep) or len(h):
            out.append({"block": block, "tokens": _squeeze(t[keep]), "reps": _narrow(r[keep]), "counts": packed(times[place[keep]].astype(np.uint32)), "heavy": h.tobytes(), "lists": np.array([total[x] for x in h.tolist()], np.int64).tobytes()})
    return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("tokens", "reps", "counts", "heavy", "lists"))]))


_MET = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "sigs", "src", "dst"))])


def _star(tokens: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of postings: each token with its smallest signature, and the distinct edges from there to the others."""
    order = np.lexsort((sigs, tokens))
    tokens, sigs = tokens[order], sigs[order]
    starts, lengths = _runs(tokens)
    low = np.repeat(sigs[starts], lengths)
    edges = np.unique(np.stack([low, sigs])[:, low != sigs], axis=1) if (low != sigs).any() else np.zeros((2, 0), np.int64)
    return tokens[starts], sigs[starts], edges[0], edges[1]


def _prefixes(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_pylist()
        columns = {c: texts(table[c]) for c in ("tokens", "reps", "counts", "heavy", "lists")}
        at = kinds.index(2)
        sigs, n = np.frombuffer(columns["tokens"][at], np.int64), np.frombuffer(columns["reps"][at], np.int32).astype(np.int64)
        totals = {}
        tokens, reps, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k, kind in enumerate(kinds):
            if kind == 3:
                tokens.append(_spread(columns["tokens"][k]))
                reps.append(_wide(columns["reps"][k]))
                counts.append(unpacked(columns["counts"][k]).astype(np.int64))
                totals.update(zip(np.frombuffer(columns["heavy"][k], np.uint64).tolist(), np.frombuffer(columns["lists"][k], np.int64).tolist()))
        for k, kind in enumerate(kinds):
            if kind == 1:
                heavy, local = np.frombuffer(columns["heavy"][k], np.uint64), np.frombuffer(columns["counts"][k], np.int32)
                tokens.append(np.repeat(heavy, local))
                reps.append(_wide(columns["lists"][k]))
                counts.append(np.repeat(np.array([totals[x] for x in heavy.tolist()], np.int64), local))
        tokens, reps, counts = np.concatenate(tokens), np.concatenate(reps), np.concatenate(counts)
        held = np.bincount(reps, minlength=len(n))
        take = np.maximum(0, n - (3 * n + 3) // 4 + 1 - (n - held))
        some = take[reps] > 0
        tokens, reps, counts = tokens[some], reps[some], counts[some]
        order = np.lexsort((tokens, counts, reps))
        tokens, reps = tokens[order], reps[order]
        starts, lengths = _runs(reps)
        keep = np.arange(len(reps)) - np.repeat(starts, lengths) < take[reps]
        tokens, low, src, dst = _star(tokens[keep], sigs[reps[keep]])
        names, edges = _bucket_edges(tokens, buckets)
        out = [{"bucket": name, "tokens": tokens[a:b].tobytes(), "sigs": low[a:b].tobytes()} for name, a, b in zip(names.tolist(), edges[:-1].tolist(), edges[1:].tolist())]
        out += [{"src": src.tobytes(), "dst": dst.tobytes()}] if len(src) else []
        return pa.Table.from_pylist(out, _MET)

    return run


def _meet(table: pa.Table) -> pa.Table:
    tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in texts(table["tokens"])])
    sigs = np.concatenate([np.frombuffer(x, np.int64) for x in texts(table["sigs"])])
    _, _, src, dst = _star(tokens, sigs)
    return pa.table({"src": src, "dst": dst})


def _unpack(batches):
    for batch in batches:
        for a, b in zip(texts(batch.column(0)), texts(batch.column(1))):
            yield pa.record_batch({"src": np.frombuffer(a, np.int64), "dst": np.frombuffer(b, np.int64)})


def _whole(salt: int):
    """The sets of a partition, with signature, for the smallest ``doc_id`` that has each.

    A set is given again when a smaller ``doc_id`` follows, or when it has been forgotten meanwhile,
    so that the row with the smallest of all partitions is always among them.
    """

    def run(batches):
        seen: dict[int, int | None] = {}
        for part in in_slices(batches, column="text"):
            rows = []
            for doc, x in zip(part.column(0).cast(pa.int64()).to_pylist(), shingle_sets(*flat(part.column(1)))):
                if not len(x):
                    continue
                sig, _ = signatures(x, salt)
                if sig not in seen or (doc is not None and (seen[sig] is None or doc < seen[sig])):
                    seen[sig] = doc
                    rows.append((doc, sig, x.tobytes()))
            if rows:
                a, b, c = zip(*rows)
                yield pa.record_batch({"doc_id": pa.array(a, pa.int64()), "sig": pa.array(b, pa.int64()), "shingles": pa.array(c, pa.binary())})
            if len(seen) > 200_000:
                seen.clear()

    return run


def _join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    sigs = table["sig"].to_numpy()
    _, first = np.unique(sigs, return_index=True)  # the smallest signature has the first place
    raw = texts(table["shingles"])
    roots = linked([np.frombuffer(raw[i], np.uint64) for i in first.tolist()], table["part"].to_numpy()[first])
    own = sigs[first]
    return pa.table({"node": own, "component": own[roots], "cut": pa.array([key[1].as_py() >= 0] * len(own), pa.bool_())})


def _exactly(docs: DataFrame, placed: DataFrame, pairs, salt: int) -> DataFrame:
    """Join the whole sets of each task exactly: ``(node, component, cut)``.

    ``placed`` has ``sig``, ``low`` (the smallest ``doc_id`` with that set), ``component`` and
    ``part`` (sets of one part are known to be linked); ``pairs`` are the tasks of a component that
    a set goes to, -1 for the only one. Of equal sets one row only is sent.
    """
    whole = docs.select("doc_id", "text").mapInArrow(_whole(salt), "doc_id long, sig long, shingles binary").join(placed, "sig").where("doc_id <=> low")
    dealt = whole.select("component", F.explode(pairs).alias("pair"), "sig", "part", "shingles")
    return written(dealt.groupBy("component", "pair").applyInArrow(_join, "node long, component long, cut boolean"), "ngram-joined")


def ngram_jaccard_join(docs: DataFrame, most_shingles: int = CHUNK, key: str | None = None, salt: int = 0) -> DataFrame:
    """Components of documents of which the 5-word shingle sets have a Jaccard similarity of 0.75 or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Returns ``doc_id``,
    ``n_shingles``, ``component_id`` (smallest ``doc_id`` reachable by links) and ``root`` (a number
    that names the component, whatever its ids), one row per row, and with ``key`` that binary
    column of ``docs``.

    Words are split at space and 0x09-0x0D after lower-casing A-Z. With fewer than five words the
    whole sequence is the only shingle. A null or empty text, or one of white space only, has no
    shingle and is linked with nothing: its component is its own ``doc_id``, its ``root`` null. Rows
    with equal sets are in one component, repeated rows too. A null ``doc_id`` takes part in links and
    never is the smallest, unless it is alone: then the component is null. No rows: no rows.

    A set is named by 64 bits; another 64 are compared. Should two sets have one name, the job stops
    and can be run with another ``salt``.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = docs.select("doc_id", "text", (F.col(key) if key else F.lit(None).cast("binary")).alias("key"))
    sent = written(rows.mapInArrow(_send(buckets, salt), _SENT_SQL), "ngram-sent", compression="none")
    profile = sent.where("kind = 0").select("doc_id", "key", "n", "sig", "again")
    posted = sent.where("kind = 1")
    reply = posted.select("bucket", "block", "tokens", "reps", "heavy", "counts").groupBy("bucket").applyInArrow(_count, _REPLY_SQL)
    known = reply.select(F.lit(3).alias("kind"), "block", "tokens", "reps", "counts", "heavy", "lists")
    lists = posted.where("length(heavy) > 0").select("kind", "block", F.lit(None).cast("binary").alias("tokens"), F.lit(None).cast("binary").alias("reps"), "counts", "heavy", "lists")
    sizes = sent.where("kind = 2").select("kind", "block", F.col("sigs").alias("tokens"), F.col("sizes").alias("reps"), *(F.lit(None).cast("binary").alias(c) for c in ("counts", "heavy", "lists")))
    met = written(known.unionByName(lists).unionByName(sizes).groupBy("block").applyInArrow(_prefixes(buckets), _MET_SQL), "ngram-met", compression="none")
    profile = written(profile.coalesce(max(1, buckets // 8)), "ngram-profile")  # few numbers of each row
    deleted(sent)
    near = met.where("src IS NOT NULL").select("src", "dst").mapInArrow(_unpack, "src long, dst long")
    far = met.where("tokens IS NOT NULL").select("bucket", "tokens", "sigs").groupBy("bucket").applyInArrow(_meet, "src long, dst long")
    linked_sets = components(near.unionByName(far))
    deleted(met)
    one = F.when(F.min("again") == F.max("again"), F.first("n")).otherwise(F.raise_error(F.lit("two sets have one name: run again with another salt")).cast("long"))
    sets = written(profile.where("sig IS NOT NULL").groupBy("sig").agg(one.alias("n"), F.min("doc_id").alias("low")), "ngram-sets")
    candidates = written(linked_sets.join(sets, linked_sets.node == F.col("sig")).select("sig", "n", "low", "component"), "ngram-candidates")
    deleted(linked_sets)
    few = candidates.count() <= BROADCAST_ROWS
    large = candidates.groupBy("component").agg(F.sum("n").alias("total")).where(F.col("total") > most_shingles)
    large = large.select("component", F.ceil(F.col("total") / most_shingles).alias("chunks"))
    placed = candidates.join(large, "component", "left").withColumn("chunk", F.expr("pmod(xxhash64(sig), chunks)")).withColumn("part", F.col("sig"))
    zero = F.lit(0).cast("long")
    every = F.sequence(zero, F.col("chunks") - 1)
    to = F.when(F.col("chunks").isNull(), F.array(F.lit(-1).cast("long"))).when(F.col("chunk") == 0, every).otherwise(F.array("chunk"))
    joined = _exactly(docs, F.broadcast(placed) if few else placed, to, salt)
    label = joined.where("NOT cut").select("node", "component")
    cut, made = joined.where("cut").select(F.col("node").alias("src"), F.col("component").alias("dst")), []
    if cut.limit(1).count():
        parts = components(cut)
        made.append(parts)
        parts = parts.withColumnRenamed("component", "known")
        known = placed.where("chunks IS NOT NULL").join(parts, F.col("sig") == F.col("node"), "left").select("sig", "n", "low", "component", "chunks", "chunk", F.coalesce("known", "sig").alias("part"))
        known = written(known, "ngram-parts")
        made.append(known)
        main = known.groupBy("component", "part").agg(F.sum("n").alias("held")).groupBy("component").agg(F.max(F.struct("held", "part")).alias("main"), F.sum("held").alias("total"))
        main = main.where("main.held < total").select("component", F.col("main.part").alias("main"), F.ceil((F.col("total") - F.col("main.held")) / most_shingles).alias("queries"))
        left = written(known.join(main, "component").withColumn("query", F.expr("IF(part <> main, pmod(xxhash64(sig, 1), queries), NULL)")), "ngram-left")
        made.append(left)
        if left.limit(1).count():
            to = F.transform(F.sequence(zero, F.col("queries") - 1), lambda j: j * F.col("chunks") + F.col("chunk"))
            to = F.when(F.col("query").isNull(), to).otherwise(F.array_union(to, F.transform(every, lambda c: F.col("query") * F.col("chunks") + c)))
            again = _exactly(docs, F.broadcast(left) if few else left, to, salt)
            cut = cut.unionByName(again.select(F.col("node").alias("src"), F.col("component").alias("dst")))
            parts = components(cut)
            made += [again, parts]
            parts = parts.withColumnRenamed("component", "known")
        label = label.unionByName(parts.select("node", F.col("known").alias("component")))
    nodes = written(label.join(candidates.select("sig", "low"), F.col("node") == F.col("sig")).select("sig", "low", F.col("component").alias("root")), "ngram-nodes")
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id")).hint("rebalance")  # dealt out apart, so that Spark can split a large component's rows
    named = sets.join(nodes.join(lowest, "root").select("sig", "root", "component_id"), "sig", "left")
    named = written(named.select("sig", F.coalesce("root", "sig").alias("root"), F.coalesce("component_id", "low").alias("component_id")), "ngram-named")
    deleted(nodes, sets, candidates, joined, *made)
    out = profile.join(named, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root", *(["key"] if key else []))
