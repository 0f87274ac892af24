"""WARC archives with a two-level capture index.

Writing: each page is a gzip member of its own. Among records of equal payloads of some
length, the one with the largest page_id is a ``response``, the others are ``revisit``
records that refer to it. Tasks write archives under a name of their attempt; the table of
captures names those of committed tasks only.

Index: captures are sorted by reversed-host key (com,example)/path) and cut into compressed
blocks of lines; a sparse directory keeps the first and last key and the place of each block.

Look-up: the keys of a table of URLs (``look_up``) or one URL's (``Lookup``) search the directory by
bisection, then the block that it names, read by its range, by bisection too. The directory is
broadcast in slices of at most ``BROADCAST_BYTES``, in order of keys, one job each.

Reading: captures in order of archive and offset, with neighbouring ranges read at once.

Defined results: a null html is an empty payload; a null url has an empty key and no target
header; rows that share the largest page_id of a payload are all responses; null page_ids
count as smaller than any and, where nothing but nulls shares a payload, all are responses;
repeated rows are records of their own; extra columns take no part; no rows give no rows.
The url of a record read back is that of its header: characters that a header or URI may not
hold (control characters, spaces, beyond ASCII) are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, stored
from .files import filesystem

ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 1_000
#: Ranges less than this apart are read at once, up to this many bytes.
JOIN_GAP, JOIN_BYTES = 4 << 10, 4 << 20
#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "surt string, page_id long, type string, file string, position long, size long"
DIRECTORY = "first_key string, last_key string, file string, position long, size long, n long, part int"
WANTED = "surt string, file string, position long, size long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """Reversed host, then the rest: http://a.b.com:80/x?y -> com,b,a:80)/x?y."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower().removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return ")" + url
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")
    return ",".join(reversed(host.split("."))) + port + ")" + path


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    return fields, rest[:n]


def row(fields: dict[str, str], block: bytes) -> tuple:
    """A record as a row of RECORDS; the digest of a response is that of the bytes read."""
    http, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if revisit:
        size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    else:
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        if found != said:
            raise ValueError("a payload of another digest than its header says")
    page, refers = fields.get("Page-ID"), fields.get("Refers-To-Page-ID")
    return (int(page) if page else None, fields.get("WARC-Target-URI"), None if revisit else payload, size, said, fields["WARC-Type"], int(refers) if refers else None)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


def write(pages: DataFrame, folder: str | None = None, least: int = 1000, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write the archives; the stored table of captures."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    same = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    same = stored(same.select("digest", "refers_to"), "same-payload")
    if same.count() * 80 <= BROADCAST_BYTES:  # else a sort-merge join
        same = F.broadcast(same)
    rows = base.join(same, "digest", "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        out, name = None, ""
        for batch in batches:
            found = []
            for page_id, url, body, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(name, compression=None)
                revisit = refers_to is not None and page_id != refers_to
                pack = zlib.compressobj(level, wbits=31)
                data = pack.compress(record(page_id, url, body, digest, refers_to, revisit, date)) + pack.flush()
                found.append((surt(url), page_id, "revisit" if revisit else "response", name, out.tell(), len(data)))
                out.write(data)
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield _table(found, CAPTURES)
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(run, CAPTURES), "captures")


def build_index(captures: DataFrame, folder: str | None = None, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index blocks; their directory as a stored table."""
    spark = captures.sparkSession
    folder = folder or scratch(spark, "cdx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        out, name, held, found = None, "", [], []

        def flush() -> None:
            nonlocal out, name
            if not held:
                return
            if out is None:
                fs.create_dir(root, recursive=True)
                name = f"{root}/{uuid.uuid4().hex}.cdx.gz"
                out = fs.open_output_stream(name, compression=None)
            pack = zlib.compressobj(6, wbits=31)
            data = pack.compress("".join(f"{json.dumps(list(x))}\n" for x in held).encode()) + pack.flush()
            found.append((held[0][0], held[-1][0], name, out.tell(), len(data), len(held), TaskContext.get().partitionId()))
            out.write(data)
            held.clear()

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(x)
                if len(held) >= lines:
                    flush()
        flush()
        if out is not None:
            out.close()
        yield _table(found, DIRECTORY)

    parts = max(1, captures.count() // (32 * lines))
    order = ["surt", "page_id", F.xxhash64("file"), "position"]  # the hash: what Spark samples for the ranges stays short
    return stored(captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, DIRECTORY), "directory")


def _block(file: str, position: int, size: int) -> list[list]:
    fs, path = filesystem(file)
    with fs.open_input_file(path) as f:
        return [json.loads(x) for x in zlib.decompress(f.read_at(size, position), wbits=31).splitlines()]


def captures_of(directory: DataFrame) -> DataFrame:
    """All captures, from the blocks of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, position, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _table(_block(file, position, size), CAPTURES)

    n = max(1, min(directory.count(), 4 * directory.sparkSession.sparkContext.defaultParallelism))
    return directory.select("file", "position", "size").repartition(n, "file", "position").mapInArrow(run, CAPTURES)


def _slices(directory: DataFrame) -> list[tuple[int, int]]:
    """Ranges of parts of the directory that may be broadcast; parts are in order of keys."""
    size = F.sum(F.octet_length("first_key") + F.octet_length("last_key") + 100).alias("size")
    out, held = [], 0
    for part, size in sorted(tuple(r) for r in directory.groupBy("part").agg(size).collect()):  # a row for each 32 blocks
        if not out or held + size > BROADCAST_BYTES:
            out.append((part, part))
            held = 0
        out[-1], held = (out[-1][0], part), held + size
    return out


def look_up(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """All captures of the URLs of a table (url), by the directory and its blocks."""

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([(surt(u),) for u in batch.column(0).to_pylist()], "surt string")

    spark = urls.sparkSession
    keys = stored(urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(keys_of, "surt string").distinct(), "keys")
    wanted = None
    for low, high in _slices(directory):
        rows = directory.where(F.col("part").between(low, high)).select("first_key", "last_key", "file", "position", "size")
        rows = sorted(tuple(r) for r in rows.collect())  # BROADCAST_BYTES at most, or one part
        part = keys.where(F.col("surt").between(rows[0][0], rows[-1][1])).mapInArrow(_searching(spark.sparkContext.broadcast(rows)), WANTED)
        wanted = part if wanted is None else wanted.unionByName(part)
    if wanted is None:
        return spark.createDataFrame([], CAPTURES)

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lines, keys = None, [], []
        for batch in batches:
            found = []
            for key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at:
                    at, lines = place, _block(*place)
                    keys = [x[0] for x in lines]
                found += lines[bisect_left(keys, key) : bisect_right(keys, key)]
            yield _table(found, CAPTURES)

    wanted = stored(wanted, "wanted")
    n = max(1, min(wanted.count() // 500, 64 * spark.sparkContext.defaultParallelism))
    return stored(wanted.repartition(n, "file", "position").sortWithinPartitions("file", "position", "surt").mapInArrow(search_blocks, CAPTURES), "found")


def _searching(sent):
    def search_directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        first, last = [r[0] for r in rows], [r[1] for r in rows]
        for batch in batches:
            found = []
            for key in batch.column(0).to_pylist():
                found += [(key, *r[2:]) for r in rows[bisect_left(last, key) : bisect_right(first, key)]]
            yield _table(found, WANTED)

    return search_directory


def read(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of captures, as RECORDS (payload null unless asked for).

    A revisit has no payload of its own: its length and digest are those of its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            found, i = [], 0
            while i < len(ranges):
                file, begin, size = ranges[i]
                j, end = i + 1, begin + size
                while j < len(ranges) and ranges[j][0] == file and 0 <= ranges[j][1] - end <= JOIN_GAP and ranges[j][1] + ranges[j][2] - begin <= JOIN_BYTES:
                    end = ranges[j][1] + ranges[j][2]
                    j += 1
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    data = f.read_at(end - begin, begin)
                for _, at, n in ranges[i:j]:
                    r = row(*parse(zlib.decompress(data[at - begin : at - begin + n], wbits=31)))
                    found.append(r if payloads else (*r[:2], None, *r[3:]))
                i = j
            yield _table(found, RECORDS)

    n = max(1, min(captures.count() // 500 + 1, 64 * captures.sparkSession.sparkContext.defaultParallelism))
    stretch = F.floor(F.col("position") / JOIN_BYTES)
    return captures.select("file", "position", "size").repartition(n, "file", stretch).sortWithinPartitions("file", "position").mapInArrow(run, RECORDS)


class Lookup:
    """Captures and records of single URLs.

    Up to ``most`` blocks the directory (some hundred bytes for each thousand captures) is held
    here in order of keys and searched by bisection; beyond, Spark filters it for each URL.
    """

    def __init__(self, spark: SparkSession, directory: DataFrame, most: int = 1_000_000):
        self.directory, self.rows = directory, None
        if directory.count() <= most:
            self.rows = [tuple(r) for r in directory.orderBy("first_key", "last_key", "file", "position").collect()]
            self.first, self.last = [r[0] for r in self.rows], [r[1] for r in self.rows]

    def captures(self, url: str | None) -> list[list]:
        key = surt(url)
        if self.rows is None:
            blocks = self.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect()
        else:
            blocks = self.rows[bisect_left(self.last, key) : bisect_right(self.first, key)]
        out = []
        for _, _, file, position, size, *_ in blocks:
            lines = _block(file, position, size)
            keys = [x[0] for x in lines]
            out += lines[bisect_left(keys, key) : bisect_right(keys, key)]
        return out

    def records(self, url: str | None) -> list[tuple]:
        out = []
        for _, _, _, file, position, size in self.captures(url):
            fs, path = filesystem(file)
            with fs.open_input_file(path) as f:
                out.append(row(*parse(zlib.decompress(f.read_at(size, position), wbits=31))))
        return out
