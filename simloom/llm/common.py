"""Shared plumbing of the training-data operators: shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session. Only where it is unset and all run on one machine, as in
    tests, a temporary folder is made and put into the session for later calls. A cluster without
    the setting has no folder that executors share: that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="simloom-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch between the JVM and Python; both hold whole batches of texts.
ARROW_ROWS = 2000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Set the session to Arrow batches of ``ARROW_ROWS`` rows at most, where it has Spark's default of 10,000."""
    if spark.conf.get(_ARROW) == "10000":
        spark.conf.set(_ARROW, str(ARROW_ROWS))


def written(df: DataFrame, name: str, *partition_by: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage.

    A lost executor can then only cost the tasks that were running on it, and a recomputation
    never sees other values than those that were first written. Blobs that are compressed already,
    and hashes, are best written with ``compression="none"``.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).options(compression=compression, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextlib.contextmanager
def short_shuffles(spark: SparkSession):
    """Shuffle files of what is run here are removed as soon as it ends; what is run must not be run again."""
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def plain_names(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with numbered column names but for those to ``keep``: ``mapInArrow`` takes no names with dots."""
    return docs.toDF(*(c if c in keep else f"column_{k}" for k, c in enumerate(docs.columns)))


def deleted(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once all that is computed from them is written itself."""
    for table in tables:
        remove_folder(table.sparkSession, table._written_to)


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """How many ways to deal out data: the session's shuffle partitions, which follow the input's size."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes; null counts as empty."""
    data, offsets = flat(column)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def in_slices(batches, most_bytes: int = 1 << 18, column: str = "text"):
    """Cut Arrow batches to slices of about ``most_bytes`` of text, so that memory stays bounded.

    A single longer text is a slice of its own.
    """
    for batch in batches:
        _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def packed(x: np.ndarray) -> bytes:
    """A one-dimensional array of unsigned integers as planes of bytes, compressed: high bytes are often alike."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return bytes([x.itemsize]) + len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpacked(raw: bytes) -> np.ndarray:
    size, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(f"u{size}").ravel()
