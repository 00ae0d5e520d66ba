"""Recordings as tables: tar members, dimensions, embeddings, appended results."""

from __future__ import annotations

import json
import math
import os
import re
import tarfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.msgpack import unpack
from simloom.functions.text import episode_of, frame_of, path_part
from simloom.functions.vector import l2_normalize
from simloom.sources.results import files_of, without

_COLUMNS = ["path", "key", "camera", "kind", "content"]
MEMBERS = "path string, key string, camera string, kind string, content binary"


class Encoder(Protocol):
    """A model that turns texts or images to vectors. Made once for each worker."""

    def encode(self, items: list) -> list[list[float]]: ...


def listed(spark: SparkSession, *globs: str) -> DataFrame:
    """``(path, length)`` of the files of some folders, with all below them; contents are not read. Nothing there: no rows."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(globs)).select("path", "length")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long")


def dataset_folders(spark: SparkSession, root: str, split: str | None = None, most: int | None = None) -> DataFrame:
    """``(task_name, dataset_dir, folder)`` of the data sets in ``root/task_*/``, by name, at most ``most``.

    Without ``split`` these are the folders not named ``*_split``; with it the split's folder in
    those that are: split2 for "train", else split1. Folders without files are no data sets.
    """
    part = "" if split is None else "split2/" if split == "train" else "split1/"
    below = re.escape(re.sub(r"^\w+://[^/]*", "", root.rstrip("/")))
    pieces = [F.regexp_extract("path", rf"^(.*?{below}/(task_[^/]+)/([^/]+)/{part})[^/]", k).alias(c) for k, c in ((2, "task_name"), (3, "dataset_dir"), (1, "folder"))]
    folders = listed(spark, f"{root}/task_*").select(*pieces).where("folder <> ''").distinct().where(F.col("dataset_dir").endswith("_split") == F.lit(split is not None))
    folders = folders.orderBy("task_name", "dataset_dir")
    return folders if most is None else folders.limit(most)


def dataset_tars(spark: SparkSession, root: str, split: str, most: int | None = None) -> DataFrame:
    """``(path, length)`` of the tars of a split, by name, at most ``most``: "eval" is one folder, others are dealt to ``part-*``."""
    tars = listed(spark, f"{root}/eval/webdataset" if split == "eval" else f"{root}/{split}/part-*/webdataset")
    tars = tars.where(F.col("path").rlike(r"/dataset-[^/]*\.tar$")).orderBy("path")
    return tars if most is None else tars.limit(most)


def webdataset_tars(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, task_name, dataset_dir)`` of all tars below ``root`` that stand in a folder ``webdataset``, by path."""
    tars = listed(spark, root).where(F.col("path").rlike(r"/webdataset/.*\.tar$")).orderBy("path")
    return tars.withColumns({"task_name": path_part(F.col("path"), "webdataset", 1), "dataset_dir": path_part(F.col("path"), "webdataset", 2)})


def fetched(uri: str, folder: str, attempts: int = 3, wait: float = 2.0, copy: Callable[[str, str], None] | None = None) -> str:
    """The local copy of a tar in a worker's ``folder``; fetched if there is none that opens, in ``attempts`` tries.

    A copy of up to 1024 bytes, or one that is no tar, is fetched again. ``copy(uri, path)`` brings it.
    """
    path = os.path.join(folder, re.sub(r"^[a-z0-9]+://", "", uri).replace("/", "_"))

    def opens() -> bool:
        if not os.path.exists(path) or os.path.getsize(path) <= 1024:
            return False
        try:
            tarfile.open(path).close()
        except tarfile.TarError:
            return False
        return True

    if opens():
        return path
    os.makedirs(folder, exist_ok=True)
    for attempt in range(attempts):
        part = f"{path}.{uuid.uuid4().hex}"
        try:
            (copy or _copied)(uri, part)
            os.replace(part, path)
            return path
        except OSError:
            if os.path.exists(part):
                os.remove(part)
            if attempt + 1 == attempts:
                raise
            time.sleep(wait)
    raise ValueError("at least one attempt is needed")


def _copied(uri: str, path: str) -> None:
    files, name = files_of(uri)
    with files.open_input_stream(name) as source, open(path, "wb") as out:
        while block := source.read(1 << 22):
            out.write(block)


def tar_members(spark: SparkSession, *paths: str, cameras: tuple[str, ...] = ("cam_high",), batch_bytes: int = 16 << 20) -> DataFrame:
    """Members of tar files, with episode and frame of the key before the first dot.

    Tars are the unit of parallel work. A task opens the path itself and reads member after member, so
    that it holds about ``batch_bytes`` at a time whatever the tar's size. Images of other cameras are
    left out before their bytes leave the worker; a tar that can't be read gives the rows before the
    place where it breaks off.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(list(paths)).select("path")

    def run(batches: Iterator[pd.DataFrame]):
        for rows in batches:
            for path in rows["path"]:
                source, name = files_of(path)
                out, held = [], 0
                try:
                    with source.open_input_stream(name, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                        for member in tar:
                            key, _, rest = member.name.rpartition("/")[2].partition(".")
                            camera, _, kind = rest.rpartition(".")
                            if member.isfile() and (kind != "jpg" or camera in cameras):
                                out.append((path, key, camera, kind, tar.extractfile(member).read()))
                                held += member.size
                                if held >= batch_bytes:
                                    yield pd.DataFrame(out, columns=_COLUMNS)
                                    out, held = [], 0
                except (tarfile.TarError, EOFError):
                    pass
                yield pd.DataFrame(out, columns=_COLUMNS)

    members = files.repartition(max(1, min(files.count(), 4096)), "path").mapInPandas(run, MEMBERS)
    return members.withColumns({"episode": episode_of(F.col("key")), "frame": frame_of(F.col("key")), "task_name": path_part(F.col("path"), "webdataset", 1), "dataset_dir": path_part(F.col("path"), "webdataset", 2)})


def grouped_members(members: DataFrame, needed: str = "meta") -> DataFrame:
    """``(path, key, members)``: the members of each key together, of keys that have a ``needed`` one only."""
    groups = members.groupBy("path", "key").agg(F.sort_array(F.collect_list(F.struct("camera", "kind", "content"))).alias("members"))
    return groups.where(F.exists("members", lambda m: m["camera"] == needed))


def frame_metadata(members: DataFrame, fields: str, decode: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Metadata members decoded to ``fields`` (a DDL list), JSON and MessagePack by their kind, or all by ``decode``. Fields that are lists give their first element."""
    names = [x.split()[0] for x in fields.split(",")]

    def first(x):
        return x[0] if isinstance(x, list) and x else x

    def run(batches: Iterator[pd.DataFrame]):
        for rows in batches:
            found = [(decode or (unpack if kind == "msgpack" else json.loads))(x) for x, kind in zip(rows["content"], rows["kind"])]
            yield pd.concat([rows[["path", "episode", "frame"]].reset_index(drop=True), pd.DataFrame({n: [first(x.get(n)) for x in found] for n in names})], axis=1)

    return members.where("camera LIKE 'meta%' OR kind IN ('json', 'msgpack')").mapInPandas(run, f"path string, episode long, frame long, {fields}")


def task_dimension(spark: SparkSession, path: str) -> DataFrame:
    """``(task_index, task)`` of a file of JSON lines; of repeated indexes the last line counts."""
    lines = spark.read.schema("task_index long, task string").json(path).withColumn("line", F.monotonically_increasing_id())
    return lines.groupBy("task_index").agg(F.max(F.struct("line", "task")).alias("x")).select("task_index", F.col("x.task").alias("task"))


def parquet_frames(spark: SparkSession, *globs: str) -> DataFrame:
    """``(path, episode, task_index, frame_index)`` of episode files; only two columns are read, unreadable files are skipped."""
    rows = spark.read.option("ignoreCorruptFiles", "true").parquet(*globs).select(F.col("_metadata.file_path").alias("path"), "task_index", "frame_index")
    return rows.withColumn("episode", F.regexp_extract("path", r"episode_(\d+)", 1).cast("long"))


def encoded(rows: DataFrame, column: str, make: Callable[[], Encoder], batch: int = 24, normalise: bool = False) -> DataFrame:
    """``rows`` with a ``vector`` of ``column``: each distinct value is encoded once, in batches, by a model made once for each task; ``normalise``: to unit length."""

    def run(batches: Iterator[pd.DataFrame]):
        model = make()
        for part in batches:
            for k in range(0, len(part), batch):
                piece = part.iloc[k : k + batch]
                yield piece.assign(vector=model.encode(piece[column].tolist()))

    distinct = rows.select(column).distinct().where(F.col(column).isNotNull())
    vectors = distinct.mapInPandas(run, f"`{column}` {rows.schema[column].dataType.simpleString()}, vector array<double>")
    if normalise:
        vectors = vectors.withColumn("vector", l2_normalize(F.col("vector")))
    return rows.join(vectors, column, "left")


def preflight(make: Callable[[], Encoder], items: list) -> int:
    """Encode some made-up items before a long run; gives the vectors' width, or an error if they are not alike and finite."""
    vectors = make().encode(items)
    widths = {len(v) for v in vectors}
    if len(vectors) != len(items) or len(widths) != 1 or not all(math.isfinite(x) for v in vectors for x in v):
        raise ValueError(f"{len(vectors)} vectors of widths {sorted(widths)} for {len(items)} items, or values that are not finite")
    return widths.pop()


def append_new(rows: DataFrame, path: str, key: str, drop: tuple[str, ...] = ()) -> None:
    """Append the rows whose key the Parquet table at ``path`` does not hold yet, without the columns to ``drop``, so that a run that broke off can go on."""
    spark = rows.sparkSession
    rows = without(rows, *drop)
    try:
        there = spark.read.parquet(path).select(key)
    except AnalysisException as missing:  # no table yet
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows.write.mode("append").parquet(path)
        return
    rows.join(there, key, "left_anti").write.mode("append").parquet(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a JSON file: a bare list, or an object with the list ``pairs``."""
    rows = spark.read.option("multiLine", "true").json(path)
    return rows.select(F.explode("pairs").alias("x")).select("x.*") if "pairs" in rows.columns else rows
