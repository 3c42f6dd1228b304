"""WARC archives and a two-level index of their captures.

Records are gzip members of their own, so one can be read by its range. The index is sorted by the
URL with its host reversed, in compressed blocks of lines; beside each index file lies its
directory, with the first key of each block. A look-up finds the files by their first keys, the
blocks by binary search in a directory, and reads ranges: the blocks, then the records.

Files are written by tasks, under names of their own, through the file system of the folder's
address. Those of a task that failed are left out, as only finished tasks' names go on.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import partitions

#: Bytes after which a task begins a new archive, and lines of an index block.
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 2000
#: Pages carry no time of capture.
CAPTURED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = ("page_id long, url string, url_key string, record_type string, refers_to long, payload_digest string, "
            "file string, begin long, size long")
#: A line's place in the order of the index; a null id comes first.
ORDER = ["url_key", "page_id", "file", "begin"]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """The URL without scheme, user, port 80 or 443, "www." and fragment, its host in lower case
    and reversed: ``https://www.a.org/B?c`` is ``org,a)/B?c``. A null URL has the key "-"."""
    if url is None:
        return "-"
    rest = url.split("#", 1)[0].strip()
    rest = rest.split("://", 1)[-1] if "://" in rest.split("/", 1)[0] + "//" else rest
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    name = name.removeprefix("www.")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in key)


def _safe(text: str) -> str:
    """A header's value in one line."""
    return "".join(c if c >= " " else "%%%02X" % ord(c) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A record of one capture: a response with its payload, or a revisit without, whose HTTP
    headers still tell the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>", f"WARC-Date: {CAPTURED}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {refers_to}')}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's headers, its HTTP headers and its payload; ``ValueError`` if it is broken."""
    head, found, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not found or not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


@contextmanager
def _new_file(folder: str, ending: str):
    """A file under a new name: the name, and a function that appends and returns the place."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}{ending}"
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        at = 0

        def append(data: bytes) -> int:
            nonlocal at
            out.write(data)
            at += len(data)
            return at - len(data)

        yield name, append


class Ranges:
    """Reads ranges of a folder's files, a few of which stay open."""

    def __init__(self, folder: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, name: str, begin: int, size: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(size, begin)

    def whole(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.root}/{name}", compression=None) as f:
            return f.read()


def _make_folder(folder: str) -> None:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """Writes a record per row into archives in ``folder``, and returns the captures
    (CAPTURES; kept in the folder, too).

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest id are responses
    and the others revisits of it; rows with a null id, and all smaller ones, are responses. A null
    payload is empty, a null URL leaves its header out. Other columns are not read; an empty table
    writes nothing. Payloads are shuffled only if the copies' digests are too many to send around.
    """
    _make_folder(folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload")).withColumn(
        "sha1", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    copies = rows.where(large).groupBy("sha1").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where(
        "n > 1").drop("n")
    known = rows.join(copies, "sha1", "left").select(
        "page_id", "url", "payload", F.when(large & (F.col("page_id") < F.col("latest")), F.col("latest")).alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64))
        batch = next(batches, None)
        while batch is not None:
            with _new_file(folder, ".warc.gz") as (name, append):
                size = 0
                while batch is not None and size < ARCHIVE_BYTES:
                    out = []
                    for page, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                        data = gzip.compress(record(page, url, payload, refers), 6, mtime=0)
                        out.append((page, url, url_key(url), "response" if refers is None else "revisit", refers,
                                    digest(payload), name, append(data), len(data)))
                        size += len(data)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (
                        pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(),
                        pa.int64(), pa.int64()))], [x.split()[0] for x in CAPTURES.split(", ")])
                    batch = next(batches, None)

    path = f"{folder}/captures"
    known.mapInArrow(work, CAPTURES).write.parquet(path)
    return pages.sparkSession.read.schema(CAPTURES).parquet(path)


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the sorted index, and returns its files: ``file``, ``directory`` (its name),
    ``first`` and ``last`` (url keys) and ``lines``.

    The order goes by URL and then by id, so that the captures of one URL may fill many files.
    """
    spark = captures.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, first, last, n = [], None, None, 0
        with _new_file(folder, ".cdx.gz") as (name, append):
            def flush(lines: list[tuple[str, str]]):
                data = gzip.compress("".join(x for _, x in lines).encode(), 6, mtime=0)
                entries.append(json.dumps([lines[0][0], append(data), len(data), len(lines)]))

            held: list[tuple[str, str]] = []
            for batch in batches:
                for row in batch.to_pylist():
                    first, last, n = row["url_key"] if first is None else first, row["url_key"], n + 1
                    held.append((row["url_key"], json.dumps([row[c] for c in (
                        "url_key", "page_id", "record_type", "payload_digest", "file", "begin", "size")]) + "\n"))
                    if len(held) == BLOCK_LINES:
                        flush(held)
                        held = []
            if held:
                flush(held)
        if not entries:
            return
        with _new_file(folder, ".idx.gz") as (directory, append):
            append(gzip.compress("\n".join(entries).encode(), 6, mtime=0))
        yield pa.RecordBatch.from_pydict({"file": [name], "directory": [directory], "first": [first], "last": [last], "lines": [n]})

    path = f"{folder}/index"
    captures.repartitionByRange(partitions(spark), *ORDER).sortWithinPartitions(*ORDER).mapInArrow(
        work, "file string, directory string, first string, last string, lines long").write.parquet(path)
    return spark.read.schema("file string, directory string, first string, last string, lines long").parquet(path)


RECORDS = ("url_key string, page_id long, record_type string, payload_digest string, payload_bytes long, "
           "refers_to_record string, record_id string, payload binary")


def look_up(spark: SparkSession, folder: str, keys: DataFrame, payloads: bool = True) -> DataFrame:
    """All captures of the URLs in ``keys`` (column ``url_key``; each counts once), read from the
    archives by way of the index: RECORDS. ``payload`` is null for revisits, and for all unless
    ``payloads``; a response's digest and length are taken from the payload as read, and a
    digest that differs from the record's header raises ``ValueError``.

    A key goes to the files between whose first and last key it lies, found by binary search in the list
    of files (two keys and two names for each; one file per partition of the index). Keys are dealt to
    tasks by file. A task reads one directory and one block at a time.
    """
    # one row per index file: as many as build_index had partitions
    files = sorted(spark.read.parquet(f"{folder}/index").select("first", "last", "file", "directory").collect())
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*files[i][2:], key) for key in batch.column("url_key").to_pylist()
                   for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "directory", "url_key"), x)) for x in out], pa.schema(
                [(c, pa.string()) for c in ("file", "directory", "url_key")]))

    wanted = keys.select("url_key").where("url_key is not null").distinct()
    dealt = wanted.mapInArrow(places, "file string, directory string, url_key string")
    dealt = dealt.repartition(partitions(spark), "file").sortWithinPartitions("file", "url_key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(folder)
        file, blocks, starts, done = None, [], [], -1
        lines: dict[str, list] = {}
        for batch in batches:
            for name, directory, key in zip(*(c.to_pylist() for c in batch.columns)):
                if name != file:
                    file, done, lines = name, -1, {}
                    blocks = [json.loads(x) for x in gzip.decompress(ranges.whole(directory)).decode().split("\n")]
                    starts = [b[0] for b in blocks]
                # the block before the first that starts at the key, as it may end with the key
                at = max(0, bisect.bisect_left(starts, key) - 1)
                end = bisect.bisect_right(starts, key)
                for k in range(at, end):
                    if k != done:
                        done, lines = k, {}
                        for line in gzip.decompress(ranges.read(file, *blocks[k][1:3])).decode().splitlines():
                            found = json.loads(line)
                            lines.setdefault(found[0], []).append(found)
                    hits = lines.get(key, [])
                    for i in range(0, len(hits), 64):
                        yield _records(ranges, sorted(hits[i:i + 64], key=lambda x: x[4:6]), payloads)

    return dealt.mapInArrow(work, RECORDS)


def _records(ranges: Ranges, hits: list[list], payloads: bool) -> pa.RecordBatch:
    out = []
    for key, page, kind, _, file, begin, size in hits:
        fields, http, payload = parse(gzip.decompress(ranges.read(file, begin, size)))
        told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        n = int(http["Content-Length"])
        if kind == "response" and (digest(payload) != told or len(payload) != n):
            raise ValueError(f"the payload of page {page} differs from its record's headers")
        out.append((key, page, fields["WARC-Type"], told, n, fields.get("WARC-Refers-To"), fields["WARC-Record-ID"],
                    payload if payloads and kind == "response" else None))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in RECORDS.split(", ")])
