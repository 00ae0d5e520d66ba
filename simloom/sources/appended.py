"""Tables that grow batch by batch, with a manifest of the batches that are complete.

A batch is written to a folder of its own and counts once its entry stands in the manifest, a file that is put in place by one
rename. What a run that broke off has left without an entry is never read, and is written anew. No run looks at rows that are there already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.sources.results import files_of, without


class Appended:
    """A table at ``path``, a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files, self.base = files_of(self.path)

    def entries(self) -> dict[str, dict]:
        """The complete batches by their names."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/_manifest", allow_not_found=True))
        out = {}
        for info in found:
            if info.base_name.endswith(".json"):
                with self.files.open_input_stream(info.path) as f:
                    entry = json.loads(f.read())
                out[entry["batch"]] = entry
        return out

    def append(self, batch: str, rows: DataFrame, **about) -> bool:
        """Write a batch unless it is complete already; tells whether it did. ``about`` goes to its entry."""
        if batch in self.entries():
            return False
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        entry = {"batch": batch, "folder": folder, "schema": rows.schema.json(), **about}
        self.files.create_dir(f"{self.base}/_manifest")
        part = f"{self.base}/_manifest/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps(entry).encode())
        self.files.move(part, f"{self.base}/_manifest/{batch}.json")
        return True

    def read(self) -> DataFrame | None:
        """All complete batches; None if there is none yet."""
        entries = self.entries().values()
        return self.spark.read.parquet(*(f"{self.path}/{e['folder']}" for e in entries)) if entries else None

    def next_place(self) -> int:
        """The first place of the input that no complete batch covers, as ``append_by_place`` counts."""
        return max((e.get("end", 0) for e in self.entries().values()), default=0)

    def discard_leftovers(self) -> int:
        """Remove folders of batches that broke off; tells how many. Not while another run is writing."""
        kept = {e["folder"].rpartition("/")[2] for e in self.entries().values()}
        found = self.files.get_file_info(fs.FileSelector(f"{self.base}/data", allow_not_found=True))
        left = [x.path for x in found if x.base_name not in kept]
        for path in left:
            self.files.delete_dir(path)
        return len(left)


def append_by_place(rows: DataFrame, path: str, size: int, work: Callable[[DataFrame], DataFrame] = lambda x: x, place: str = "idx", drop: tuple[str, ...] = ()) -> Appended:
    """Put ``rows`` through ``work``, ``size`` places of the input at a time, and append each result; goes on where a run broke off.

    Places are those of the input: rows that ``work`` leaves out are not tried again. Rows come to ``work`` by a filter on ``place``, which reaches the scan.
    """
    table = Appended(rows.sparkSession, path)
    end = rows.agg(F.max(place)).first()[0]
    at = table.next_place()
    while end is not None and at <= end:
        part = rows.where((F.col(place) >= at) & (F.col(place) < at + size))
        table.append(f"{at:012d}", without(work(part), *drop), begin=at, end=at + size)
        at += size
    return table
