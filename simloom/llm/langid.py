"""Language identification of mixed-language text by Viterbi over words.

A word is a run of letters (Unicode categories L and M, at least one L), lower-cased. Its score under
a language is the log-probability of its letters, each given the two before it, learned from
labelled texts. The scripts of a word, told by ranges of code points, narrow the languages that may
have it. Viterbi with a penalty for each change of language labels every word; runs of equal labels
are the spans. The language with the most words is the text's.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import deleted, in_slices, texts, written

#: Most labelled texts of each language that the model is learned from, those of least hash.
SAMPLE = 2000
#: Most languages of which the numbers of texts are broadcast.
MOST_BROADCAST = 100_000
PENALTY = 12.0
#: Texts are cut to segments of so many words, unless there are more languages than ``MOST_CUT``.
SEGMENT, MOST_CUT = 512, 12
SLOTS = 18

# The first code points of ranges of scripts, as Unicode's blocks have them. Others, such
# as those of marks and full-width forms, count as no script.
SCRIPTS = (
    ("Latin", ((0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF))),
    ("Greek", ((0x0370, 0x03FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("Armenian", ((0x0530, 0x058F),)),
    ("Hebrew", ((0x0590, 0x05FF),)),
    ("Arabic", ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE))),
    ("Syriac to NKo", ((0x0700, 0x074F), (0x0780, 0x086F))),
    ("Devanagari", ((0x0900, 0x097F), (0xA8E0, 0xA8FF))),
    ("Bengali", ((0x0980, 0x09FF),)),
    ("Gurmukhi", ((0x0A00, 0x0A7F),)),
    ("Gujarati", ((0x0A80, 0x0AFF),)),
    ("Odia", ((0x0B00, 0x0B7F),)),
    ("Tamil", ((0x0B80, 0x0BFF),)),
    ("Telugu", ((0x0C00, 0x0C7F),)),
    ("Kannada", ((0x0C80, 0x0CFF),)),
    ("Malayalam", ((0x0D00, 0x0D7F),)),
    ("Sinhala", ((0x0D80, 0x0DFF),)),
    ("Thai", ((0x0E00, 0x0E7F),)),
    ("Lao", ((0x0E80, 0x0EFF),)),
    ("Tibetan", ((0x0F00, 0x0FFF),)),
    ("Myanmar", ((0x1000, 0x109F),)),
    ("Georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    ("Ethiopic", ((0x1200, 0x139F), (0x2D80, 0x2DDF))),
    ("Khmer", ((0x1780, 0x17FF),)),
    ("Kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("Hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF))),
    ("Han", ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, whether a letter or a mark, and the bit of its script."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    letter = np.array([k == "L" for k in kinds])
    scripts = np.zeros(sys.maxunicode + 1, np.int32)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for first, last in ranges:
            scripts[first : last + 1] = 1 << k
    scripts[~letter] = 0
    return letter, letter | np.array([k == "M" for k in kinds]), scripts


def _lower(column) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the lower-cased texts, and where each begins."""
    low = [x.decode().lower() for x in texts(column)]
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First code point and end of each word, and for each text the place of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    letter, inside = (table[data] for table in _tables()[:2])
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edges[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edges[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    letters = np.concatenate([[0], np.cumsum(letter)])
    some = letters[ends] > letters[starts]
    return starts[some], ends[some], np.searchsorted(starts[some], offsets)


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter of each word, and one end mark for each word: the slot of it after its two forerunners, and of those two; and where each word begins."""
    sizes = ends - starts + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(first[-1]) - np.repeat(first[:-1] - starts, sizes)
    depth = place - np.repeat(starts, sizes)
    here = np.concatenate([data, [0]]).astype(np.uint64)[place]
    here[first[1:] - 1] = 1
    padded = np.concatenate([[0, 0], data]).astype(np.uint64)
    one = np.where(depth >= 1, padded[place + 1], np.uint64(1))
    two = np.where(depth >= 2, padded[place], np.uint64(1))
    context = (two << np.uint64(21)) | one
    gram = ((context << np.uint64(21)) | here) * np.uint64(0x9E3779B97F4A7C15)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    context = (context + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    context ^= context >> np.uint64(29)
    context *= np.uint64(0x94D049BB133111EB)
    return (gram >> np.uint64(64 - SLOTS)).astype(np.int64), (context >> np.uint64(64 - SLOTS)).astype(np.int64), first


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # [slot, language]: log-probability of a letter after its two forerunners
    scripts: np.ndarray  # bits of the scripts that a language is written in

    def emissions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first = _words(data, offsets)
        if not len(starts):
            return np.zeros((0, len(self.languages)), np.float32), first
        gram, _, at = _grams(data, starts, ends)
        score = np.add.reduceat(self.table[gram], at[:-1], axis=0)
        score -= score.max(axis=1, keepdims=True)
        np.maximum(score, -PENALTY, out=score)  # one odd word alone never pays for a change to and fro
        bounds = np.stack([starts, ends], 1).ravel()
        used = np.bitwise_or.reduceat(_tables()[2][data], bounds[:-1] if ends[-1] == len(data) else bounds)[::2]
        fits = (used[:, None] & ~self.scripts[None, :]) == 0
        score[~fits & fits.any(axis=1, keepdims=True)] = -1e4
        return score, first

    def paths(self, score: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """The language of each word on the best path of its text; of equal paths, the language that sorts first.

        Texts are cut to segments of 512 words. All segments advance together, each from every
        language it may begin in; then a text's segments are joined, and all go back together. With
        more than ``MOST_CUT`` languages that would need too much memory: texts are not cut then, and
        begin in any language for nothing.
        """
        kinds, n = len(self.languages), len(score)
        if not n:
            return np.zeros(0, np.int16)
        lengths = np.diff(first)
        most = SEGMENT if kinds <= MOST_CUT else max(1, int(lengths.max()))
        ways = kinds if kinds <= MOST_CUT else 1
        pieces = -(-lengths // most)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[text] + nth * most
        size = np.minimum(most, lengths[text] - nth * most)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        longest = int(size[0])
        live = np.searchsorted(-size, -np.arange(longest), "left")
        value = np.full((len(size), ways, kinds), -1e9 if ways > 1 else 0.0, np.float32)  # [segment, language before it, now]
        if ways > 1:
            value[:, np.arange(kinds), np.arange(kinds)] = 0
        came = np.zeros((n, ways, kinds), np.int16)  # of each word, from which language
        own = np.arange(kinds, dtype=np.int16)
        for t in range(longest):
            m = live[t]
            v = value[:m]
            top = v.argmax(axis=2).astype(np.int16)
            best = np.take_along_axis(v, top[:, :, None].astype(np.int64), 2) - penalty
            change = best > v
            came[begin[:m] + t] = np.where(change, top[:, :, None], own)
            value[:m] = np.maximum(v, best) + score[begin[:m] + t][:, None, :]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        entered, last = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        ends = np.cumsum(pieces)
        one = np.flatnonzero(pieces == 1)
        spot = back[ends[one] - 1]
        # from before the text every first language is free
        free = value[spot].max(axis=1)
        last[spot] = free.argmax(axis=1)
        entered[spot] = value[spot, :, last[spot]].argmax(axis=1)
        for k in np.flatnonzero(pieces > 1).tolist():
            spots = back[ends[k] - pieces[k] : ends[k]]
            total, choice = np.zeros(kinds, np.float32), []
            for s in spots.tolist():
                through = total[:, None] + value[s]
                choice.append(through.argmax(axis=0))
                total = through.max(axis=0)
            state = int(total.argmax())
            for s, c in zip(spots[::-1].tolist(), choice[::-1]):
                last[s] = state
                state = entered[s] = int(c[state])
        out = np.zeros(n, np.int16)
        state = last.copy()
        for t in range(longest - 1, -1, -1):
            m = live[t]
            out[begin[:m] + t] = state[:m]
            state[:m] = came[begin[:m] + t, entered[:m], state[:m]]
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """First word, end and language of each run of words in one language."""
        path = self.paths(*self.emissions(*_lower(pa.array([text]))))
        cuts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])) if len(path) else np.zeros(0, np.int64)
        return [(int(a), int(b), self.languages[path[a]]) for a, b in zip(cuts, np.append(cuts[1:], len(path)))]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return ["und"] * (len(offsets) - 1), np.zeros(len(offsets) - 1)
        score, first = self.emissions(data, offsets)
        n = len(offsets) - 1
        text = np.repeat(np.arange(n), np.diff(first))
        votes = np.bincount(text * len(self.languages) + self.paths(score, first), minlength=n * len(self.languages)).reshape(n, -1)
        total = votes.sum(axis=1)
        best = votes.argmax(axis=1)
        share = votes[np.arange(n), best] / np.maximum(total, 1)
        return [self.languages[b] if t else "und" for b, t in zip(best.tolist(), total.tolist())], share


def _learn(batches):
    """Counts of letters after two forerunners, of forerunners, and of words by script, for each batch and language."""
    for part in in_slices(batches):
        langs = np.array(part.column(part.schema.get_field_index("lang")).to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            data, offsets = _lower(part.column(part.schema.get_field_index("text")).filter(pa.array(langs == lang)))
            starts, ends, _ = _words(data, offsets)
            if not len(starts):
                continue
            gram, context, _ = _grams(data, starts, ends)
            scripts = np.array([int((_tables()[2][data] == 1 << k).sum()) for k in range(len(SCRIPTS))], np.int64)
            g, gn = np.unique(gram, return_counts=True)
            # a letter's forerunners follow from its slot, collisions aside
            c = np.zeros(1 << SLOTS, np.int32)
            c[gram] = context
            yield pa.record_batch([[lang], [g.astype(np.int32).tobytes()], [gn.astype(np.int32).tobytes()], [c[g].tobytes()], [scripts.tobytes()]], ["lang", "grams", "counts", "contexts", "scripts"])


def _merge(table: pa.Table) -> pa.Table:
    """One row for each language out of those of its batches."""
    grams, contexts = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int32)
    scripts = np.zeros(len(SCRIPTS), np.int64)
    for g, n, c, s in zip(*(texts(table[k]) for k in ("grams", "counts", "contexts", "scripts"))):
        g = np.frombuffer(g, np.int32)
        grams[g] += np.frombuffer(n, np.int32)
        contexts[g] = np.frombuffer(c, np.int32)
        scripts += np.frombuffer(s, np.int64)
    g = np.flatnonzero(grams).astype(np.int32)
    return pa.table({"lang": table["lang"][:1], "grams": pa.array([g.tobytes()]), "counts": pa.array([grams[g].astype(np.int32).tobytes()]), "contexts": pa.array([contexts[g].tobytes()]), "scripts": pa.array([scripts.tobytes()])})


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Learn from at most ``sample`` texts of each language, those of least hash of ``doc_id`` that are not held out.

    Rows with a null ``lang``, ``text`` or ``doc_id`` are not used. The ids chosen, ``sample`` for
    each language at most, are broadcast.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out())
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("of")), "language-counts")
    few = counts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    # of a large language only ids of low hash are ranked, four times as many as are wanted
    low = usable.select("doc_id", "lang").join(F.broadcast(counts) if few else counts, "lang").where(place * (F.col("of") / (4.0 * sample)) <= float(1 << 40))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = written(low.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang").distinct(), "language-sample")
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    kind = "lang string, grams binary, counts binary, contexts binary, scripts binary"
    pieces = rows.mapInArrow(_learn, kind).groupBy("lang").applyInArrow(_merge, kind).toArrow().to_pylist()
    deleted(chosen, counts)
    languages = sorted({x["lang"] for x in pieces})
    grams = np.zeros((1 << SLOTS, len(languages)))
    contexts = np.zeros((1 << SLOTS, len(languages)))
    scripts = np.zeros((len(languages), len(SCRIPTS)))
    of = np.zeros(1 << SLOTS, np.int64)
    for x in pieces:
        k = languages.index(x["lang"])
        g, n, c = (np.frombuffer(x[name], np.int32) for name in ("grams", "counts", "contexts"))
        grams[g, k] += n
        np.add.at(contexts[:, k], c, n)
        of[g] = c
        scripts[k] += np.frombuffer(x["scripts"], np.int64)
    table = np.log((grams + 0.05) / (contexts[of] + 0.05 * 40))
    bits = ((scripts >= 0.01 * scripts.sum(axis=1, keepdims=True)) @ (1 << np.arange(len(SCRIPTS)))).astype(np.int32) if languages else np.zeros(0, np.int32)
    return LanguageModel(languages, table.astype(np.float32), bits)


def held_out():
    """Whether crc32 of ``doc_id`` as text leaves 2 when divided by 4; a null ``doc_id`` counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def _predict(shared):
    def run(batches):
        for part in in_slices(batches):
            names, share = shared.value.predict(*_lower(part.column(part.schema.get_field_index("text"))))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(share, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The language of each text of ``docs``, which needs ``doc_id``, ``text`` and ``lang``; other columns are not read.

    Learned from text and ``lang`` of rows whose crc32 of ``doc_id`` as text does not leave 2 when
    divided by 4. Returns ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (the share of words
    that the best path gives to it, 0 to 1), one row per row. A null text, or one without letters,
    is ``und`` with score 0, as is every text when nothing could be learned. Ties go to the language
    that sorts first. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")
