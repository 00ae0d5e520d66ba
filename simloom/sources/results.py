"""Where results go and come back from: matrices, batches, caches, JSON."""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a summary of batches may have, the first that is there counts.
SUMMARIES = ("{name}_batches_info.json", "batches_info.json")


def files_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds ``uri``, and the path in it."""
    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")


def there(uri: str) -> bool:
    files, path = files_of(uri)
    return files.get_file_info(path).type != fs.FileType.NotFound


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``; made and written first if it is not there, as segments or cluster labels are."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def without(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without columns that results don't keep, such as images; names that are not there don't matter."""
    return rows.drop(*columns)


def write_json(rows: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    rows.write.mode("overwrite").json(path)


def npy_header(head: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and first byte of the values, of the beginning of a matrix file."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("not a matrix file")
    wide = head[6] >= 2
    size = struct.unpack_from("<I" if wide else "<H", head, 8)[0]
    begin = 12 if wide else 10
    about = ast.literal_eval(head[begin : begin + size].decode("latin1"))
    if about["fortran_order"] or len(about["shape"]) != 2:
        raise ValueError("a matrix in the order of its rows is needed")
    return np.dtype(about["descr"]), about["shape"], begin + size


def read_matrix(spark: SparkSession, path: str, rows_at_once: int = 8192) -> DataFrame:
    """``(idx, v)`` of a matrix file on a path that all executors share; each task reads the range of its own rows."""
    files, name = files_of(path)
    with files.open_input_file(name) as f:
        kind, (n, width), begin = npy_header(f.read_at(min(f.size(), 1 << 16), 0))
    pieces = spark.range(0, -(-n // rows_at_once), numPartitions=max(1, min(-(-n // rows_at_once), 4096)))

    def run(batches: Iterator[pd.DataFrame]):
        files, name = files_of(path)
        with files.open_input_file(name) as f:
            for batch in batches:
                for piece in batch["id"]:
                    first, last = piece * rows_at_once, min(n, (piece + 1) * rows_at_once)
                    raw = f.read_at((last - first) * width * kind.itemsize, begin + first * width * kind.itemsize)
                    yield pd.DataFrame({"idx": np.arange(first, last), "v": list(np.frombuffer(raw, kind).reshape(-1, width).astype(np.float32).astype(float))})

    return pieces.mapInPandas(run, "idx long, v array<double>")


def read_embeddings(spark: SparkSession, matrix: str, metadata: str) -> DataFrame:
    """A matrix file with the JSON list of metadata that stands row by row beside it: ``(idx, v, ...)``.

    The list is one file, so that its rows are numbered as they stand. An error if the two have not
    the same number of rows.
    """
    vectors = read_matrix(spark, matrix)
    about = spark.read.option("multiLine", "true").json(metadata).withColumn("idx", F.monotonically_increasing_id())
    n, m = vectors.count(), about.count()
    if n != m:
        raise ValueError(f"{n} vectors, but metadata of {m}")
    return vectors.join(about, "idx")


def batch_records(batches: DataFrame, matrix: DataFrame) -> DataFrame:
    """One nested row for each batch: its rows, the statistics of its diagonal and its matrix of similarities.

    ``batches``: ``(batch_id, slot, ego_idx, tele_idx)``; ``matrix``: ``(batch_id, i, j, sim)``.
    """
    rows = batches.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("slot", "ego_idx", "tele_idx"))).alias("x"))
    rows = rows.select("batch_id", F.size("x").alias("n_ego"), F.size("x").alias("n_tele"), F.transform("x", lambda r: r["ego_idx"]).alias("ego"), F.transform("x", lambda r: r["tele_idx"]).alias("tele"))
    line = matrix.groupBy("batch_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "sim"))), lambda r: r["sim"]).alias("sims"))
    sims = line.groupBy("batch_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "sims"))), lambda r: r["sims"]).alias("sim_matrix"))
    diagonal = matrix.where("i = j").groupBy("batch_id").agg(*(F.round(f("sim"), 6).alias(f"diag_{name}") for f, name in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))))
    return rows.join(diagonal, "batch_id").join(sims, "batch_id")


def batches_summary(records: DataFrame) -> DataFrame:
    """What all batches together come to, one row; without batches numbers are 0."""
    cuts = (0.1, 0.25, 0.5, 0.75, 0.9)
    mean = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return records.agg(F.count("*").alias("n_batches"), F.coalesce(F.max("n_ego"), F.lit(0)).alias("batch_size"), F.coalesce(F.sum("n_ego"), F.lit(0)).alias("ego_used"), F.coalesce(F.sum("n_tele"), F.lit(0)).alias("tele_used"), mean(F.avg("diag_mean")).alias("mean"), mean(F.stddev_pop("diag_mean")).alias("std"), mean(F.avg("diag_min")).alias("mean_min"), *(mean(F.percentile("diag_mean", F.lit(x))).alias(f"p{int(100 * x)}") for x in cuts))


def write_batches(records: DataFrame, folder: str, name: str = "ego_tele") -> None:
    """A JSON file for each batch, ``batch_000000.json``, and one of the summary. Tasks write their own batches."""

    def put(rows: Iterator):
        files, base = files_of(folder)
        files.create_dir(base)
        for row in rows:
            with files.open_output_stream(f"{base}/batch_{row['batch_id']:06d}.json") as f:
                f.write(json.dumps(row.asDict(recursive=True), ensure_ascii=False).encode())

    records.foreachPartition(put)
    files, base = files_of(folder)
    files.create_dir(base)
    with files.open_output_stream(f"{base}/{SUMMARIES[0].format(name=name)}") as f:
        f.write(json.dumps(batches_summary(records).first().asDict(), ensure_ascii=False).encode())


def read_batch(spark: SparkSession, batch_id: int, *folders: str) -> DataFrame:
    """The record of one batch, of the first of the ``folders`` that has it."""
    for folder in folders:
        if there(path := f"{folder.rstrip('/')}/batch_{batch_id:06d}.json"):
            return spark.read.json(path)
    raise FileNotFoundError(f"batch {batch_id} is in none of {', '.join(folders)}")


def read_summary(spark: SparkSession, folder: str, name: str = "ego_tele") -> DataFrame | None:
    """The summary of a folder's batches by the first name that is there; None if there is none."""
    for x in SUMMARIES:
        if there(path := f"{folder.rstrip('/')}/{x.format(name=name)}"):
            return spark.read.json(path)
    return None


def listed_batches(folder: str) -> list[int]:
    """The numbers of the batches that a folder holds, in order."""
    files, base = files_of(folder)
    names = (x.base_name for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True)))
    return sorted(int(x[6:-5]) for x in names if x.startswith("batch_") and x.endswith(".json") and x[6:-5].isdigit())
