"""WARC archives with a two-level capture index.

Archives are gzip members, one for each record, in files of the shared folder. The index sorts
captures by reversed-host URL key into compressed blocks, one file for each range of keys. At the end
of the file stands its sparse directory: each block's first and last key, offset and length. The
driver knows of each file only its first and last key and where its directory stands.

A search looks up in halves which files may hold a key, and deals its keys out by file, sorted. A
task reads a file's directory once, searches that in halves, reads one block by its range, and
searches that in halves too. Records are then read by their ranges, in the order of each archive.

Files are reached with ``pyarrow.fs``, so the shared folder may be a mount, HDFS or an object store.
A task that is run again writes a new file; the index lists only files of tasks that were committed.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, in_slices, shared_folder, texts, written

FILE_BYTES = 64 << 20
BLOCK_LINES = 3000
_DATE = "2024-01-01T00:00:00Z"
#: Most payloads of several rows that are broadcast: about 100 MB. Beyond, rows are joined by a shuffle that Spark can split.
BROADCAST_ROWS = 1_000_000
_INDEX_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
_INDEX_SQL = "urlkey string, page_id long, url string, file string, offset long, length long"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"(?:file:/*)?(/.*)|file:/+(.*)", uri)
    if local or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Host labels reversed, comma-joined, then ``)`` and the rest: ``org,example,www)/a?b``."""
    _, there, rest = (url or "").partition("://")
    if not there:
        rest = url or ""
    cut = re.search(r"[/?#]|$", rest).start()
    host, port, number = rest[:cut].lower().rpartition(":")
    host = host if port and number.isdigit() else rest[:cut].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the headers of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {_DATE}"]
    head += [f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def decode_record(member: bytes) -> dict:
    """The record's headers (lower-case names), ``payload``, and ``payload_length`` of the full payload."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    record = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(record["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    record["payload"], record["payload_length"] = payload, int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    return record


def _write(folder: str, file_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        files, base = file_system(folder)
        files.create_dir(base)
        task, out, name, at = TaskContext.get(), None, "", 0
        for part in in_slices(batches, column="html"):
            rows = []
            urls = part.column(1).to_pylist()
            for page_id, url, html, digest, refers_to, revisit in zip(part.column(0).to_pylist(), urls, texts(part.column(2)), *(part.column(k).to_pylist() for k in (3, 4, 5))):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                member = encode_record(page_id, url, html, digest, refers_to, revisit)
                out.write(member)
                rows.append((url_key(url), page_id, url, name, at, len(member)))
                at += len(member)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["urlkey", "page_id", "url", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _index(folder: str, block_lines: int):
    """Sorted captures to a file of compressed blocks and their directory; yields what the driver is to know of the file."""

    def run(batches):
        from pyspark import TaskContext

        files, base = file_system(folder)
        files.create_dir(base)
        name, held, at, directory, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx.z", [], 0, [], None

        def put():
            nonlocal held, at
            block = _packed(held)
            out.write(block)
            directory.append((held[0][0], held[-1][0], at, len(block), len(held)))
            held, at = [], at + len(block)

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                held.append(row)
                if len(held) >= block_lines:
                    put()
        if held:
            put()
        if out is not None:
            block = _packed(directory)
            out.write(block)
            out.close()
            yield pa.record_batch([[directory[0][0]], [directory[-1][1]], [name], [at], [len(block)], [len(directory)], [sum(x[4] for x in directory)]], ["first", "last", "file", "offset", "length", "blocks", "captures"])

    return run


def _packed(rows: list[tuple]) -> bytes:
    return zlib.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in rows).encode())


def _unpacked(block: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(block).decode().split("\n")[:-1]]


class Index:
    """Searches for captures of keys that come in order; holds one directory and one block."""

    def __init__(self, folder: str, known: list[tuple[str, str, str, int, int]]):
        self.files, self.base = file_system(folder)
        self.known = known  # (last key, first key, file, offset and length of its directory), sorted
        self.reads = 0
        self._held: dict[str, tuple] = {}

    def _range(self, level: str, name: str, offset: int, length: int) -> list[list]:
        key = (name, offset)
        if self._held.get(level, (None,))[0] != key:
            with self.files.open_input_file(f"{self.base}/{name}") as f:
                self._held[level] = (key, _unpacked(f.read_at(length, offset)))
            self.reads += 1
        return self._held[level][1]

    def files_of(self, key: str):
        """Numbers of the files that may hold ``key``."""
        at = bisect.bisect_left(self.known, (key,))
        while at < len(self.known) and self.known[at][1] <= key:
            yield at
            at += 1

    def within(self, number: int, key: str):
        """``(urlkey, page_id, url, file, offset, length)`` of each capture of ``key`` in one file."""
        _, _, name, offset, length = self.known[number]
        directory = self._range("directory", name, offset, length)
        for first, _, offset, length, _ in directory[bisect.bisect_left(directory, key, key=lambda x: x[1]) :]:
            if first > key:
                return
            lines = self._range("block", name, offset, length)
            a, b = (f(lines, key, key=lambda x: x[0]) for f in (bisect.bisect_left, bisect.bisect_right))
            yield from lines[a:b]

    def captures(self, key: str):
        for number in self.files_of(key):
            yield from self.within(number, key)


def _route(folder: str, shared):
    """A row for each file of the index that may hold a key, so that one with very many captures is many rows."""

    def run(batches):
        index = Index(folder, shared.value)
        for batch in batches:
            rows = [(number, key) for key in batch.column(0).to_pylist() for number in index.files_of(key)]
            numbers, keys = zip(*rows) if rows else ((), ())
            yield pa.record_batch({"number": pa.array(numbers, pa.int64()), "urlkey": pa.array(keys, pa.string())})

    return run


def _find(folder: str, shared):
    def run(batches):
        index = Index(folder, shared.value)
        for batch in batches:
            for number, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = index.within(number, key)
                while rows := list(itertools.islice(found, 4096)):
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), _INDEX_TYPES)], ["urlkey", "page_id", "url", "file", "offset", "length"])

    return run


def _url_keys(batches):
    for batch in batches:
        yield pa.record_batch([pa.array([url_key(x) for x in batch.column(0).to_pylist()], pa.string())], ["urlkey"])


def _read(folder: str):
    def run(batches):
        files, base = file_system(folder)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, files.open_input_file(f"{base}/{file}")
                r = decode_record(f.read_at(length, offset))
                digest, kind = r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"]
                if kind == "response" and (base32_sha1(r["payload"]) != digest or len(r["payload"]) != r["payload_length"]):
                    raise ValueError(f"{file} at {offset}: the payload does not fit its digest")
                number = lambda k: int(r[k]) if k in r else None
                rows.append((number("x-page-id"), r["payload_length"], digest, kind, number("x-refers-to-page")))
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f is not None:
            f.close()

    return run


@dataclass
class Archive:
    """Archives and their index in the shared folder. ``files``: one row for each file of the index."""

    spark: SparkSession
    records: str
    blocks: str
    files: DataFrame
    _known: list | None = None

    def known(self) -> list[tuple[str, str, str, int, int]]:
        """One entry for each file of the index, of which there are as many as tasks wrote it."""
        if self._known is None:
            self._known = sorted(tuple(x) for x in self.files.select("last", "first", "file", "offset", "length").collect())
        return self._known

    def find(self, urls: DataFrame) -> DataFrame:
        """The captures of the different keys of ``urls`` (a column ``url``), found in the index."""
        keys = urls.select("url").mapInArrow(_url_keys, "urlkey string").distinct()
        shared = self.spark.sparkContext.broadcast(self.known())
        routed = keys.mapInArrow(_route(self.blocks, shared), "number long, urlkey string")
        return routed.repartitionByRange("number", "urlkey").sortWithinPartitions("number", "urlkey").mapInArrow(_find(self.blocks, shared), _INDEX_SQL)

    def read(self, urls: DataFrame) -> DataFrame:
        """All records of the keys of ``urls``, read by range in the order of each archive."""
        dealt = self.find(urls).select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(_read(self.records), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def lookup(self, url: str) -> list[dict]:
        """The records of one URL."""
        files, root = file_system(self.records)
        found = []
        for *_, name, offset, length in Index(self.blocks, self.known()).captures(url_key(url)):
            with files.open_input_file(f"{root}/{name}") as f:
                found.append(decode_record(f.read_at(length, offset)))
        return found


def write_archive(pages: DataFrame, file_bytes: int = FILE_BYTES, block_lines: int = BLOCK_LINES) -> Archive:
    """Write a WARC record for each row of ``pages`` (``page_id``, ``url``, ``html``), and the capture index.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads, those with the
    largest ``page_id`` are responses; all others are revisits of it. A null ``page_id`` is never
    the largest, unless all of the group are null: then all are responses. Repeated rows with the
    largest ``page_id`` are all responses. A null or empty ``url`` has the key ``)/``. Other columns
    are not read. No rows: an empty index.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("sha1"))
    groups = rows.groupBy("sha1").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("group_sha1"), "largest")
    groups = written(groups, "warc-groups")
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(groups) if few else groups, F.col("sha1") == F.col("group_sha1"), "left")
    revisit = F.coalesce(F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")), F.lit(False))
    rows = rows.select("page_id", "url", "html", F.col("sha1").alias("digest"), F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))
    records, blocks = shared_folder(spark, "warc-records"), shared_folder(spark, "warc-index")
    captures = written(rows.mapInArrow(_with_base32(_write(records, file_bytes)), _INDEX_SQL), "warc-captures")
    order = captures.repartitionByRange("urlkey", "page_id").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    files = written(order.mapInArrow(_index(blocks, block_lines), "first string, last string, file string, offset long, length long, blocks long, captures long"), "warc-directory")
    deleted(groups, captures)
    return Archive(spark, records, blocks, files)


def _with_base32(write):
    """The writer, for digests that come as hexadecimal."""

    def run(batches):
        def turned():
            for batch in batches:
                digests = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(3).to_pylist()]
                yield batch.set_column(3, "digest", pa.array(digests, pa.string()))

        yield from write(turned())

    return run
