"""Tar files as a data source: ``spark.read.format("tar")``, with filters on camera, kind and path pushed into the scan.

A partition is a tar, or with an index (``index_tars``) a run of members of about the same size, read from its first
byte on. Members that a pushed filter rules out are passed over; their contents are read only where they have to be skipped through.
The columns are those of the given schema, all by default; without ``content`` in it no contents are read at all from an indexed tar.

    register(spark)
    spark.read.format("tar").option("index", folder).schema("key string, content binary").load("dir/*.tar").where("camera = 'cam_high'")
"""

from __future__ import annotations

import fnmatch
import re
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from simloom.sources.recordings import MEMBERS, fetched, listed
from simloom.sources.results import files_of

BATCH_BYTES, SPLIT_BYTES = 16 << 20, 128 << 20
_TYPES = {"path": pa.string(), "key": pa.string(), "camera": pa.string(), "kind": pa.string(), "content": pa.binary()}
_INDEX = "path string, name string, header long, place long, size long"


def parts_of(name: str) -> tuple[str, str, str]:
    """Key, camera and kind of a member's name: what is before the first dot, between, and after the last."""
    key, _, rest = name.rpartition("/")[2].partition(".")
    camera, _, kind = rest.rpartition(".")
    return key, camera, kind


def index_tars(spark: SparkSession, path: str, *globs: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Write where the members of tars are to the Parquet table at ``path``: ``(path, name, header, place, size, split)``.

    A task goes from header to header of a tar and reads no contents. A tar that can't be read gives the members before the place where it
    breaks off.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for rows in batches:
            for uri in rows["path"]:
                files, name = files_of(uri)
                found = []
                try:
                    with files.open_input_file(name) as source, tarfile.open(fileobj=source, mode="r:") as tar:
                        for m in tar:
                            if m.isfile():
                                found.append((uri, m.name, m.offset, m.offset_data, m.size))
                except (tarfile.TarError, EOFError):
                    pass
                yield pd.DataFrame(found, columns=["path", "name", "header", "place", "size"])

    tars = listed(spark, *globs).where("path LIKE '%.tar'").select("path")
    places = tars.repartition(max(1, min(tars.count(), 4096)), "path").mapInPandas(run, _INDEX)
    before = Window.partitionBy("path").orderBy("header").rowsBetween(Window.unboundedPreceding, -1)
    split = F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / split_bytes)
    places.withColumn("split", split.cast("long")).write.mode("overwrite").parquet(path)


def _tars_at(pattern: str) -> list[str]:
    """Tars at a path, in all below a folder, or that fit a pattern, by name; listed without a session, as a source plans apart from it."""
    files, name = files_of(pattern)
    scheme = re.match(r"\w+://", pattern)
    base = re.split(r"[*?\[]", name)[0]
    if base == name and files.get_file_info(name).type == fs.FileType.File:
        found = [name]
    else:
        below = fs.FileSelector(base if base == name else base.rpartition("/")[0], allow_not_found=True, recursive=True)
        found = [f.path for f in files.get_file_info(below) if f.type == fs.FileType.File and f.path.endswith(".tar")]
        if base != name:
            found = [p for p in found if fnmatch.fnmatchcase(p, name)]
    return sorted(f"{scheme[0] if scheme and scheme[0] != 'file://' else 'file:'}{p}" for p in found)


@dataclass
class Part(InputPartition):
    """Members of one tar whose headers stand from ``first`` to before ``end``; all of them without an index."""

    path: str
    first: int | None = None
    end: int | None = None


class TarSource(DataSource):
    """Options: ``index`` (table of ``index_tars``), ``cache`` (a local folder for whole copies of tars), ``batch_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> TarReader:
        return TarReader(schema, dict(self.options))


class TarReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        unknown = [f.name for f in schema.fields if f.name not in _TYPES]
        if unknown:
            raise ValueError(f"a tar has no column {', '.join(unknown)}: {', '.join(_TYPES)}")
        self.columns, self.options = [f.name for f in schema.fields], options
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equalities and lists of values of path, key, camera and kind are kept here, the others are Spark's."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("path", "key", "camera", "kind"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column] = self.only.get(column, values) & values
            else:
                yield f

    def wanted(self, **values: str) -> bool:
        return all(values[c] in allowed for c, allowed in self.only.items() if c in values)

    def partitions(self) -> list[Part]:
        if index := self.options.get("index"):
            files, name = files_of(index)
            table = pyarrow.dataset.dataset(name, filesystem=files, format="parquet").to_table(columns=["path", "split", "header", "place", "size"])
            groups = table.append_column("end", pyarrow.compute.add(table["place"], table["size"])).group_by(["path", "split"]).aggregate([("header", "min"), ("end", "max")])
            rows = sorted((r["path"], r["header_min"], r["end_max"]) for r in groups.to_pylist())
            return [Part(*r) for r in rows if self.wanted(path=r[0])]
        return [Part(p) for p in _tars_at(self.options["path"]) if self.wanted(path=p)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        most = int(self.options.get("batch_bytes", BATCH_BYTES))
        out, held = [], 0
        try:
            for values, size in self._members(part):
                out.append(values)
                held += size
                if held >= most:
                    yield self._batch(out)
                    out, held = [], 0
        except (tarfile.TarError, EOFError):
            pass
        if out:
            yield self._batch(out)

    def _members(self, part: Part):
        uri = f"file:{fetched(part.path, self.options['cache'])}" if "cache" in self.options else part.path
        files, name = files_of(uri)
        with files.open_input_file(name) as source:
            if part.first is not None:
                source.seek(part.first)
            # from a member's header on, a tar is a tar again
            with tarfile.open(fileobj=source, mode="r:") as tar:
                for m in tar:
                    if part.end is not None and m.offset >= part.end:
                        return
                    key, camera, kind = parts_of(m.name)
                    if m.isfile() and self.wanted(path=part.path, key=key, camera=camera, kind=kind):
                        content = tar.extractfile(m).read() if "content" in self.columns else None
                        values = {"path": part.path, "key": key, "camera": camera, "kind": kind, "content": content}
                        yield [values[c] for c in self.columns], m.size if content is not None else 100

    def _batch(self, rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, _TYPES[n]) for n, c in zip(self.columns, zip(*rows))], names=self.columns)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take filters: Spark asks Python sources only where that is set."""
    spark.dataSource.register(TarSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tars(spark: SparkSession, path: str, columns: str = MEMBERS, **options: str) -> DataFrame:
    """Members of tars at ``path``, a folder, file or pattern."""
    register(spark)
    return spark.read.format("tar").options(**options).schema(columns).load(path)
