"""WARC archives with a two-level capture index.

Archives: one gzip member per record (WARC/1.1). Of records with equal payloads of at least
``MIN_REVISIT`` bytes that with the largest page id is a response, the others are revisits of it;
smaller payloads are always responses. Repeated rows of that largest page are all responses, as a page
does not revisit itself. A null html is an empty payload; a null page id is less than any other.

Index: captures sorted by reversed-host URL key (``com,example,www)/path``) in zlib blocks of
``BLOCK_LINES`` lines. Each index file ends with a sparse directory (first key, offset and size of each
block) and the list of index files holds the first and last key of each. A lookup finds the file, binary-
searches the directory, reads that block and then the records' byte ranges. A key whose captures span
several files is looked up in each. A null URL has the empty key. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewloom.session import Scratch

from . import files

MIN_REVISIT = 1000
BLOCK_LINES = 512
#: An archive file is closed once it has so many bytes.
FILE_BYTES = 512 << 20
#: Archive bytes that one task of a lookup reads.
TASK_BYTES = 32 << 20
#: Captures that go into one index file.
SHARD_CAPTURES = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TAIL = struct.Struct("<QQ8s")
MAGIC = b"SKWCDX01"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def url_key(url: str | None) -> str:
    """Reversed-host key; scheme, user, fragment and a leading ``www.`` do not count."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"!{url}"
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) if host else ""
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    return f"urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzip member; ``digest`` is bare hexadecimal SHA-1, ``refers_to`` makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> dict:
    """Headers and payload of a record; a response's digest is computed anew."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        made = hashlib.sha1(payload).hexdigest()
        if made != said or len(payload) != size:
            raise ValueError(f"record of page {fields['X-Page-ID']} is damaged")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


CAPTURES = "key string, page_id long, path string, offset long, length long"


def _write(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, out, rows = TaskContext.get().partitionId(), 0, None, []

        def done() -> pa.RecordBatch:
            out.close()
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CAPTURES.split(", ")])

        for b in batches:
            for page, url, html, digest, to in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].cast(pa.binary()), b["digest"].to_pylist(), b["refers_to"].to_pylist(), strict=True):
                if out is None:
                    path = f"{folder}/pages-{task:06d}-{number:04d}.warc.gz"
                    out, rows = files.Writer(path), []
                member = record(page, url, html.as_py() or b"", digest, to)
                rows.append((url_key(url), page, path, out.size, len(member)))
                out.write(member)
                if out.size >= file_bytes:
                    yield done()
                    out, number = None, number + 1
        if out is not None:
            yield done()

    return run


def write(scratch: Scratch, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives and returns the captures: ``key page_id path offset length``."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    digested = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    same = digested.where(F.octet_length("html") >= MIN_REVISIT).groupBy(F.col("digest").alias("d_digest")).agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    # Written, so that the join can split a payload of very many pages.
    same = scratch.table(same.where("n > 1 AND top IS NOT NULL").select("d_digest", "top"), "equal")
    met = digested.join(same, digested["digest"] == same["d_digest"], "left")
    to = F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    ready = met.select("page_id", "url", "html", "digest", to.alias("refers_to"))
    made = scratch.table(ready.mapInArrow(_write(folder := scratch.path("archives"), file_bytes), CAPTURES), "captures")
    files.sweep(folder)
    return made


SHARDS = "path string, first string, last string, captures long, bytes long"


def _tail(at: int, size: int) -> bytes:
    return TAIL.pack(at, size, MAGIC)


def _index(folder: str, block_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.cdx"
        out, block, directory, first, last, n, size = None, [], [], None, None, 0, 0

        def flush() -> None:
            packed = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in block).encode(), 6)
            directory.append((block[0][0], out.size, len(packed)))
            out.write(packed)
            block.clear()

        for b in batches:
            for row in zip(*[b[c].to_pylist() for c in ("key", "page_id", "path", "offset", "length")], strict=True):
                out = out or files.Writer(path)
                first, last, n, size = row[0] if first is None else first, row[0], n + 1, size + row[4]
                block.append(row)
                if len(block) >= block_lines:
                    flush()
        if out is not None:
            if block:
                flush()
            packed, at = zlib.compress(json.dumps(directory, ensure_ascii=False).encode()), out.size
            out.write(packed)
            out.write(_tail(at, len(packed)))
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first": [first], "last": [last], "captures": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def index(scratch: Scratch, captures: DataFrame, shard_captures: int = SHARD_CAPTURES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the index files and returns their list, one row per file."""
    order = ["key", "page_id", "path", "offset"]
    n = max(1, -(-captures.count() // shard_captures))
    ranged = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = scratch.table(ranged.mapInArrow(_index(folder := scratch.path("index"), block_lines), SHARDS), "shards")
    files.sweep(folder)
    return made


class IndexFile:
    """One index file: its directory in memory, one block at a time."""

    def __init__(self, path: str):
        self.file = files.reader(path)
        at, size, magic = TAIL.unpack(self.file.read_at(TAIL.size, self.file.size() - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no index file")
        self.directory = json.loads(zlib.decompress(self.file.read_at(size, at)))
        self.firsts = [x[0] for x in self.directory]
        self.held, self.lines, self.keys = -1, [], []

    def _block(self, k: int) -> None:
        if k != self.held:
            _, at, size = self.directory[k]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(size, at)).decode().split("\n")]
            self.held, self.keys = k, [x[0] for x in self.lines]

    def find(self, key: str) -> Iterator[tuple]:
        """The captures of a key: it may start in the block before the first one that begins with it."""
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.directory) and self.firsts[k] <= key:
            self._block(k)
            yield from self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]
            k += 1


FOUND = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"
PLACES = "key string, path string, offset long, length long"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b["url"].to_pylist()], pa.string())], names=["key"])


def _route(firsts: list[str], lasts: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, to = [], []
            for key in b["key"].to_pylist():
                k = bisect.bisect_left(lasts, key)
                while k < len(firsts) and firsts[k] <= key:
                    keys.append(key)
                    to.append(k)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(to, pa.int32())], names=["key", "shard"])

    return run


def _places(paths: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, -1
        for b in batches:
            rows = []
            for key, shard in zip(b["key"].to_pylist(), b["shard"].to_pylist(), strict=True):
                if shard != at:
                    held, at = IndexFile(paths[shard]), shard
                for _, _, path, offset, length in held.find(key):
                    rows.append((key, path, offset, length))
                    if len(rows) >= 10_000:
                        yield _batch(rows, PLACES)
                        rows = []
            if rows:
                yield _batch(rows, PLACES)

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archives: OrderedDict = OrderedDict()
    names = [c.split()[0] for c in FOUND.split(", ")]
    for b in batches:
        rows = []
        for key, path, offset, length in zip(*[b[c].to_pylist() for c in ("key", "path", "offset", "length")], strict=True):
            if path not in archives:
                archives[path] = files.reader(path)
                if len(archives) > 64:
                    archives.popitem(last=False)[1].close()
            got = parse(archives[path].read_at(length, offset))
            rows.append((key, *[got[c] for c in names[1:7]], path, offset, length))
            if len(rows) >= 2000:
                yield _batch(rows, FOUND)
                rows = []
        if rows:
            yield _batch(rows, FOUND)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def lookup(shards: DataFrame, urls: DataFrame, url_col: str = "url", task_bytes: int = TASK_BYTES) -> DataFrame:
    """All captures of the URLs, read from the archives' byte ranges. The list of index files is on the driver.

    Index files are searched by as many tasks as there are files, so a key of very many captures is spread over all that hold
    it; the records are then read by stretches of an archive, some ``task_bytes`` a task, whatever their keys.
    """
    listed = sorted(shards.collect(), key=lambda r: r["path"])
    keys = urls.select(F.col(url_col).alias("url")).mapInArrow(_keys, "key string").distinct()
    routed = keys.mapInArrow(_route([r["first"] for r in listed], [r["last"] for r in listed]), "key string, shard int")
    spread = routed.repartition(max(1, len(listed)), "shard").sortWithinPartitions("shard", "key")
    places = spread.mapInArrow(_places([r["path"] for r in listed]), PLACES)
    n = max(1, -(-sum(r["bytes"] for r in listed) // task_bytes))
    stretch = F.floor(F.col("offset") / (task_bytes // 4))
    return places.repartition(n, F.col("path"), stretch).sortWithinPartitions("path", "offset").mapInArrow(_records, FOUND)
