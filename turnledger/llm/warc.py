"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per record: a response with the page's payload, or
a revisit where an equal payload is stored under a smaller page id. Each task writes a file
of its own under a fresh name and returns the places of its records; only places returned by
the attempt that succeeded are indexed, so files of lost attempts are never read.

``write_index`` sorts the captures by URL key (host reversed: ``org,example,www)/path``) in
ranges, packs each range into compressed blocks of ``BLOCK_LINES`` lines, and writes a
sparse directory with the first key and place of each block. ``read_captures`` finds a key by
binary search in the list of ranges (as many as the index has parts), then in the
directory of one range, reads that one block, searches it, and reads the record by its range.

Defined cases: a null html is an empty payload, a null url has the empty key; repeated rows
are records of their own, those that carry the smallest page id of their payload are
responses; a null page id is larger than any other; an empty table writes nothing; extra
columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm.stages import fresh_path, written

BLOCK_LINES = 1000
FILE_BYTES = 64 << 20
MIN_REVISIT = 0


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def url_key(url: str | None) -> str:
    """Host reversed, then the rest; scheme, fragment, user, ``www`` and default ports do not count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip()
    if host.startswith("www."):
        host = host[4:]
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(url: str | None, page_id: int | None, digest: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(raw) + packer.flush()


def parse_record(raw: bytes) -> dict:
    """Fields of one record (a gzip member): headers, and the payload (None in a revisit)."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    page = lambda name: None if "none" in headers[name] else int(headers[name][len("<urn:page:") : -1])
    revisit = headers["WARC-Type"] == "revisit"
    return {
        "page_id": page("WARC-Record-ID"),
        "record_type": headers["WARC-Type"],
        "refers_to": page("WARC-Refers-To") if revisit else None,
        "digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        "length": length,
        "payload": None if revisit else payload,
    }


_PLACES = "url_key string, page_id bigint, file string, at bigint, size bigint"


def _archive_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, keep, large in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "keep_id", "large"))):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                revisit = large and page_id != keep
                member = _record(url, page_id, payload_digest(payload), payload, keep, revisit)
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                    ["url_key", "page_id", "file", "at", "size"],
                )
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write a record a page into ``folder``; returns the written table of places."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    first = rows.groupBy("sha").agg(F.min("page_id").alias("keep_id"))
    met = rows.join(first, "sha").select(
        "page_id", "url", "payload", "keep_id", (F.octet_length("payload") >= min_revisit).alias("large")
    )
    system, path = open_folder(folder)
    system.create_dir(path)
    return written(met.mapInArrow(_archive_writer(folder), _PLACES), "captures")


_DIRECTORY = "part int, first_key string, file string, at bigint, size bigint, lines int"


def _index_writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        name = f"index-{uuid.uuid4().hex}"
        out, at, lines, blocks = None, 0, [], []

        def flush():
            nonlocal at, lines
            block = zlib.compress("\n".join(lines).encode(), 6)
            out.write(block)
            blocks.append((json.loads(lines[0])[0], f"{name}.blocks", at, len(block), len(lines)))
            at += len(block)
            lines = []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "at", "size"))):
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}.blocks", compression=None)
                lines.append(json.dumps(row))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is None:
            return
        out.close()
        with system.open_output_stream(f"{path}/{name}.directory", compression=None) as f:
            f.write(json.dumps(blocks).encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([blocks[0][0]]), pa.array([f"{name}.directory"]), pa.array([len(blocks)], pa.int32())],
            ["first_key", "file", "blocks"],
        )

    return write


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Blocks and directories of the captures in ``folder``; returns its parts: first key and
    directory file, one row a range."""
    ranges = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "at")
    return written(ranges.mapInArrow(_index_writer(folder), "first_key string, file string, blocks int"), "index_parts")


class CaptureReader:
    """Look-ups in one archive folder. Keeps a few directories and blocks."""

    def __init__(self, folder: str, parts: list[tuple[str, str]], keep: int = 4):
        self.system, self.path = open_folder(folder)
        self.parts = sorted(parts)
        self.keys = [k for k, _ in self.parts]
        self.keep, self.directories, self.blocks, self.files = keep, OrderedDict(), OrderedDict(), OrderedDict()

    def _cached(self, store: OrderedDict, key, make):
        if key not in store:
            store[key] = make()
            if len(store) > self.keep:
                old = store.popitem(last=False)[1]
                if store is self.files:
                    old.close()
        store.move_to_end(key)
        return store[key]

    def _range(self, name: str, at: int, size: int) -> bytes:
        file = self._cached(self.files, name, lambda: self.system.open_input_file(f"{self.path}/{name}"))
        file.seek(at)
        return file.read(size)

    def _directory(self, name: str) -> list:
        def load():
            with self.system.open_input_stream(f"{self.path}/{name}", compression=None) as f:
                return json.loads(f.read())

        return self._cached(self.directories, name, load)

    def captures(self, key: str) -> Iterator[tuple]:
        """(page_id, file, at, size) of every capture of a URL key, by binary searches."""
        # A key may go on from one block or range into the next: start left of its first one.
        p = max(0, bisect.bisect_left(self.keys, key) - 1)
        while p < len(self.parts) and self.keys[p] <= key:
            blocks = self._directory(self.parts[p][1])
            firsts = self._cached(self.directories, (self.parts[p][1], "keys"), lambda: [b[0] for b in blocks])
            b = max(0, bisect.bisect_left(firsts, key) - 1)
            while b < len(blocks) and firsts[b] <= key:
                _, name, at, size, _ = blocks[b]
                lines = self._cached(
                    self.blocks, (name, at), lambda: [json.loads(x) for x in zlib.decompress(self._range(name, at, size)).decode().split("\n")]
                )
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while i < len(lines) and lines[i][0] == key:
                    yield tuple(lines[i][1:])
                    i += 1
                b += 1
            p += 1

    def record(self, file: str, at: int, size: int) -> dict:
        return parse_record(self._range(file, at, size))


_READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload_ok boolean"


def _key_reader(folder: str, parts: list[tuple[str, str]]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = CaptureReader(folder, parts)
        for batch in batches:
            rows = []
            for key in batch.column("url_key").to_pylist():
                for _, file, at, size in reader.captures(key):
                    x = reader.record(file, at, size)
                    whole = x["payload"] is None or (len(x["payload"]) == x["length"] and payload_digest(x["payload"]) == x["digest"])
                    rows.append((x["page_id"], x["length"], x["digest"], x["record_type"], x["refers_to"], whole))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return read


def read_captures(keys: DataFrame, folder: str, parts: DataFrame) -> DataFrame:
    """Every capture of every row of ``keys`` (column url_key), read from the archives.

    Keys are sorted in ranges, so a task stays in neighbouring blocks of few directories.
    """
    held = [(r["first_key"], r["file"]) for r in parts.select("first_key", "file").collect()]
    ordered = keys.select("url_key").repartitionByRange("url_key").sortWithinPartitions("url_key")
    return ordered.mapInArrow(_key_reader(folder, held), _READ)


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    folder = fresh_path(spark, "warc")
    captures = write_archives(pages, folder)
    parts = write_index(captures, folder)
    return read_captures(captures.select("url_key").distinct(), folder, parts)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, body, min(page_id) OVER (PARTITION BY body) AS keep, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, 1 + 5 * (j // 4), 5) AS INTEGER) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to, TRUE AS payload_ok
FROM m
"""
