"""Token files: every id against the tokenizer itself, what is read of a file, odd rows."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from simloom.llm import token_files as op
from simloom.llm.queries import op11_token_ids

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
PLAIN = tokenizers.Tokenizer.from_file(PATH)
#: Extra columns with names that the operator uses inside.
SCHEMA = "doc_id long, text string, start long, `ids` string, part int"


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4"))


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    pieces = ["a", "é", " ", " ", " ", "  ", "\n", "1", "'s", "日", "　", ".", ",", "<|endoftext|>", "Ж", "\U0001f642", "\t", "word", "٣", "\u0085", " ", "x́", "\x00"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(n)]


def test_chunks_give_the_tokenizers_own_ids():
    texts = odd_texts(3000) + ["word, other word. word; third? " * 50]
    raw = [x.encode() for x in texts]
    ids, first = op.Encoder(PATH).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ids_of(x)[:-1] for x in texts]


def test_checksums_of_joined_runs():
    a, b = bytes(range(200)), bytes(range(77))
    assert op.joined_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert op.joined_crc32(5, 0, 0) == 5


@pytest.mark.parametrize("part,piece,remembered", [(1 << 16, 1 << 22, 1 << 19), (7, 200, 3)])
def test_all_ids_in_order(spark, part, piece, remembered):
    """Odd texts, a null id, an id that many rows have, a long text in pieces, one without a place to cut."""
    rows = list(enumerate(odd_texts(60, 2))) + [(None, "no id"), (7, None), (7, ""), (7, "again"), (7, "again"), (900, "long words, and more of them. " * 400), (901, "日" * 500)]
    files = op.token_files(table(spark, rows), PATH, part=part, piece=piece, remembered=remembered)
    got = [r.asDict() for r in files.digests().collect()]
    lists = files.tokens().orderBy("start", "part").collect()
    assert sorted((r["n_tokens"], r["ids_crc32"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got) == sorted((len(ids_of(t)), crc(ids_of(t)), -1 if i is None else i) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, *sorted(i for i, _ in rows if i is not None)]
    whole = [x for r in lists for x in r["ids"]]
    assert len(whole) == at and all(len(r["ids"]) <= part for r in lists)
    for r in got:
        assert crc(whole[r["start"] : r["start"] + r["n_tokens"]]) == r["ids_crc32"]


def test_no_rows(spark):
    files = op.token_files(table(spark, []), PATH)
    assert files.digests().collect() == [] and files.metadata().collect() == []


def test_files_are_read_in_part(spark):
    """Encodings and page indexes as stated; a filter reaches the scan; lengths are read without ids."""
    files = op.token_files(table(spark, [(k, t) for k, t in enumerate(odd_texts(500, 3))]), PATH)
    names = {}
    for path in Path(files.path.removeprefix("file://")).glob("*.parquet"):
        group = pq.ParquetFile(path).metadata.row_group(0)
        for k in range(group.num_columns):
            column = group.column(k)
            names[column.path_in_schema] = set(column.encodings)
            assert column.has_offset_index
            assert column.has_column_index
    assert "RLE_DICTIONARY" in names["ids.list.element"] and "DELTA_BINARY_PACKED" in names["start"] and "DELTA_BINARY_PACKED" in names["doc_id"]
    plan = files.tokens(3, 400)._jdf.queryExecution().toString()
    assert "In(doc_id, [3,400])" in plan
    assert {r["doc_id"]: list(r["ids"]) for r in files.tokens(3, 400).collect()} == {k: ids_of(odd_texts(500, 3)[k]) for k in (3, 400)}
    assert "ids" not in files.metadata()._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0].replace("n_ids", "")


def test_query(spark):
    got = op11_token_ids(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy(F.col("doc_id")).collect()
    at, want = 0, []
    for r in docs:
        ids = ids_of(r["text"])
        want.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in got) == want
