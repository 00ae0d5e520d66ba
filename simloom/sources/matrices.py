"""One file out of many tasks: a matrix, or a JSON list, of which every task writes its rows where they belong.

``spark.write.format("ranges")`` takes rows ``(place, content)``: bytes and where they go in a file of a size that is known
before. Tasks write to one hidden file in parallel; a task that is run again writes the same bytes to the same place. Commit
checks that all bytes are there and gives the file its name, abort removes it: the file is whole, or it is not there. The folder must be one that the
driver and all executors reach as files; object stores can't write in the middle of an object.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from simloom.operators.segments import numbered, running
from simloom.operators.similarity import TILE, block_of, tiles
from simloom.sources.results import without

_RANGES = "place long, content binary"


@dataclass
class Written(WriterCommitMessage):
    n: int


class RangesSource(DataSource):
    """Options: ``path``, ``size`` of the whole file, ``header`` (hexadecimal bytes at its beginning)."""

    @classmethod
    def name(cls) -> str:
        return "ranges"

    def schema(self) -> str:
        return _RANGES

    def writer(self, schema: StructType, overwrite: bool) -> RangesWriter:
        return RangesWriter(dict(self.options), overwrite)


class RangesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.size, self.header = _local(options["path"]), int(options["size"]), bytes.fromhex(options.get("header", ""))
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        folder, name = os.path.split(self.path)
        os.makedirs(folder, exist_ok=True)
        self.open_path = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        with open(self.open_path, "wb") as f:
            f.write(self.header)
            f.truncate(self.size)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        n, file = 0, os.open(self.open_path, os.O_WRONLY)
        try:
            for batch in batches:
                for place, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    view = memoryview(content.as_buffer())
                    n += len(view)
                    while len(view):
                        done = os.pwrite(file, view, place)
                        place, view = place + done, view[done:]
            os.fsync(file)
        finally:
            os.close(file)
        return Written(n)

    def commit(self, messages: list) -> None:
        n = len(self.header) + sum(m.n for m in messages if m)
        if n != self.size:
            os.remove(self.open_path)
            raise ValueError(f"{self.path}: {n} bytes were written, {self.size} are wanted")
        os.replace(self.open_path, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.open_path):
            os.remove(self.open_path)


def _local(uri: str) -> str:
    if "://" in uri and not uri.startswith("file:"):
        raise ValueError(f"{uri}: parts of a file can be written to a shared folder only")
    return "/" + uri.removeprefix("file:").lstrip("/")


def _put(ranges: DataFrame, path: str, size: int, header: bytes = b"") -> None:
    ranges.sparkSession.dataSource.register(RangesSource)
    ranges.write.format("ranges").options(size=str(size), header=header.hex()).mode("overwrite").save(path)


def matrix_header(rows: int, width: int, kind: str = "<f4") -> bytes:
    """The beginning of a matrix file, of a multiple of 64 bytes."""
    about = f"{{'descr': '{kind}', 'fortran_order': False, 'shape': ({rows}, {width}), }}"
    about += " " * (-(10 + len(about) + 1) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(about).to_bytes(2, "little") + about.encode("latin1")


def write_matrix(rows: DataFrame, path: str) -> None:
    """``(idx, v)`` as one matrix file of four-byte values, a row each in the order of ``idx``. Vectors must be of one width; no rows give a file of none."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least")).first()
    width = size["width"] or 0
    if width != (size["least"] or 0):
        raise ValueError(f"vectors of {size['least']} to {width} values")
    header = matrix_header(size["n"], width)

    def packed(batches):
        for part in batches:
            yield pd.DataFrame({"place": part["pos"] * 4 * width + len(header), "content": [np.asarray(v, "<f4").tobytes() for v in part["v"]]})

    ranges = numbered(rows.select("idx", "v"), "idx").select("pos", "v").mapInPandas(packed, _RANGES)
    _put(ranges, path, len(header) + 4 * width * size["n"], header)


def write_json_list(rows: DataFrame, path: str, key: str = "idx") -> None:
    """Rows as one JSON list in the order of ``key``, which they do not keep; each record's place is the running sum of those before."""
    record = F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != key)), {"ignoreNullFields": "false"})
    texts = rows.select(F.col(key).alias("idx"), F.concat(F.lit(",\n"), record).cast("binary").alias("content"))
    placed = running(texts, F.octet_length("content").cast("long"), "end", F.col("idx"))
    total = texts.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    # the first record's comma is the list's bracket
    first = F.col("end") == F.octet_length("content")
    content = F.when(first, F.concat(F.lit(b"[\n"), F.expr("substring(content, 3)"))).otherwise(F.col("content"))
    ranges = placed.select((F.col("end") - F.octet_length("content")).alias("place"), content.alias("content"))
    end = rows.sparkSession.createDataFrame([(total, b"\n]" if total else b"[]")], _RANGES)
    _put(ranges.unionByName(end), path, total + 2)


def write_embeddings(rows: DataFrame, matrix: str, metadata: str, *drop: str) -> None:
    """``(idx, v, ...)`` as a matrix file, and all other columns but those to ``drop`` as a JSON list in the same order."""
    write_matrix(rows, matrix)
    write_json_list(without(rows, "v", *drop), metadata)


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors by their place among all, ``rows`` of neighbouring places in a block."""
    schema = "block int, ids array<long>, tasks array<long>, groups array<long>, matrix binary"
    placed = numbered(vectors.select("idx", "v"), "idx").select(F.col("pos").alias("idx"), F.lit(0).cast("long").alias("task"), F.lit(0).cast("long").alias("grp"), "v", F.expr(f"CAST(pos DIV {rows} AS INT)").alias("block"))
    out = placed.groupBy("block").applyInPandas(lambda part: block_of(part)[0], schema)
    out._blocks = -(-vectors.count() // rows)
    return out


def write_cross_matrix(ego: DataFrame, tele: DataFrame, path: str, most: int = 500_000_000, rows: int = TILE) -> bool:
    """All similarities as one matrix file, if there are fewer than ``most``; tells whether it was written. Row ``i``, column ``j`` are those by ``idx``."""
    n, m = ego.count(), tele.count()
    if n * m >= most:
        return False
    header = matrix_header(n, m)

    def kernel(x, y, sims, own):
        short = sims.astype("<f4")
        return pd.DataFrame({"place": len(header) + 4 * (x[0] * m + y[0][0]), "content": [r.tobytes() for r in short]})

    _put(tiles(_blocks(ego, rows), _blocks(tele, rows), kernel, _RANGES), path, len(header) + 4 * n * m, header)
    return True

