"""WARC archives with a two-level capture index.

Writing: pages with equal payloads are one group; the smallest page_id becomes the response and holds the payload, the
others are revisit records that refer to it. Each record is a gzip member of its own, so that a byte range is enough
to read it. Archives go to the shared folder under a name of their own for each attempt, and only those of attempts
that ended are listed.

Index: every archive is read back once, record by record, which gives a capture line for each: its key (the host
reversed, then the path), page id, archive, offset and length. Lines are sorted by key over range partitions and packed
into compressed blocks of BLOCK_LINES lines; the directory keeps the first key of each block and where the block
lies. A lookup finds its block by binary search in the directory, its lines by binary search in the block, and then
reads just the byte ranges of the records.

Defined cases: null html is an empty payload; a null url has the empty key; payloads under `least` bytes are always
responses; repeated rows keep a record each (rows that repeat a group's smallest page_id are all responses); an empty
table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialize, pages, shared_dir
from .ordered import partitions

BLOCK_LINES = 1000
LEAST_REVISIT = 0
#: Rows of a table of group heads up to which it is broadcast (16 bytes each); beyond that it is joined by a shuffle.
BROADCAST_HEADS = 500_000
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_GZIP = 31


def escaped(url: str | None) -> str:
    """The address as it stands in a record's head: on one line, without tabs or outer spaces."""
    return (url or "").strip().replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def url_key(url: str | None) -> str:
    """Host labels in reverse, comma-separated, then the path and query: com,example,www)/a?b."""
    url = escaped(url)
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    named = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{named}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode().rstrip("=")


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has no body."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {escaped(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, _GZIP)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + _END + body + _END) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Head and body of an unpacked record."""
    head, _, rest = member.partition(_END)
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    size = int(fields["Content-Length"])
    body, end = rest[:size], rest[size : size + 4]
    if len(body) != size or end != _END:
        raise ValueError("a record is cut short")
    return fields, body


def _id(field: str | None) -> int | None:
    text = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def opened(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def members(file: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, holding one of them at a time."""
    at, data = 0, file.read(chunk)
    while data:
        unpacker, out, used = zlib.decompressobj(_GZIP), [], 0
        while not unpacker.eof:
            if not data:
                raise ValueError("an archive is cut short")
            out.append(unpacker.decompress(data))
            used += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data if unpacker.eof else file.read(chunk)
        yield at, used, b"".join(out)
        at += used
        data = data or file.read(chunk)


def with_roles(table: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload and refers_to of every page; payloads are compared by SHA-256 of all their bytes."""
    rows = table.select(column(table, "page_id", "long").alias("page_id"), column(table, "url", "string").alias("url"), F.coalesce(column(table, "html", "string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256)).withColumn("place", F.coalesce("page_id", F.lit((1 << 63) - 1)))
    groups = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    heads = materialize(groups, "payload-groups")
    joined = rows.join(F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("first").isNotNull() & (F.col("place") > F.col("first")), F.col("first")).alias("refers_to"))


ARCHIVES = "path string, records long, bytes long"


def write(table: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write the archives, one for each partition; returns the list of them."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = fs.FileSystem.from_uri(folder)
        out, n, size = None, 0, 0
        file = f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(name, recursive=True)
                out = system.open_output_stream(f"{name}/{file}", compression=None)
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = record(page_id, url or "", html.encode("utf-8", "surrogatepass"), refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{file}"]), pa.array([n]), pa.array([size])], schema=schema)

    return materialize(with_roles(table, least).mapInArrow(run, ARCHIVES), "archives")


CAPTURES = "key string, page_id long, path string, offset long, length long"


def captures(archives: DataFrame) -> DataFrame:
    """A capture of every record, from reading the archives through."""
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with opened(path) as file:
                    for at, size, member in members(file):
                        fields, _ = parse(member)
                        rows.append((url_key(fields["WARC-Target-URI"]), _id(fields["WARC-Record-ID"]), path, at, size))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInArrow(run, CAPTURES)


DIRECTORY = "first_key string, last_key string, lines int, path string, offset long, length long"
_DIRECTORY = pa.schema(
    [("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def build_index(found: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write sorted capture lines in compressed blocks, a file for each range; returns the directory of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = fs.FileSystem.from_uri(folder)
        file, out, at, lines = f"{uuid.uuid4().hex}.cdx", None, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal at, out
            if out is None:
                system.create_dir(name, recursive=True)
                out = system.open_output_stream(f"{name}/{file}", compression=None)
            data = zlib.compress("\n".join(x for _, x in lines).encode("utf-8", "surrogatepass"))
            out.write(data)
            row = (lines[0][0], lines[-1][0], len(lines), f"{folder}/{file}", at, len(data))
            at += len(data)
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _DIRECTORY, strict=True)], schema=_DIRECTORY)

        for batch in batches:
            for key, page_id, path, offset, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines.append((key, "\t".join((key, "" if page_id is None else str(page_id), path, str(offset), str(size)))))
                if len(lines) == block_lines:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()

    dealt = found.repartitionByRange(partitions(found), "key", "page_id").sortWithinPartitions("key", "page_id")
    return materialize(dealt.mapInArrow(run, DIRECTORY), "capture-directory")


def block_lines_at(path: str, offset: int, length: int) -> list[list[str]]:
    """The capture lines of one block, by a range read."""
    with opened(path) as file:
        file.seek(offset)
        return [x.split("\t") for x in zlib.decompress(file.read(length)).decode("utf-8", "surrogatepass").split("\n")]


class Index:
    """Lookup by binary search. The sparse directory (a row for each BLOCK_LINES captures) is held on this machine;
    beyond MAX_DIRECTORY blocks give a directory that is filtered by key range beforehand."""

    MAX_DIRECTORY = 2_000_000

    def __init__(self, directory: DataFrame) -> None:
        if (n := directory.count()) > self.MAX_DIRECTORY:
            raise ValueError(f"{n} blocks: filter the directory by key range first")
        self.blocks = sorted(tuple(r) for r in directory.collect())
        self.last = sorted(b[1] for b in self.blocks)

    def captures(self, url: str) -> Iterator[list[str]]:
        """Capture lines of a URL."""
        key = url_key(url)
        for k in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            first, _, _, path, offset, length = self.blocks[k]
            if first > key:
                break
            lines = block_lines_at(path, offset, length)
            at = bisect.bisect_left(lines, key, key=lambda x: x[0])
            while at < len(lines) and lines[at][0] == key:
                yield lines[at]
                at += 1

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Heads and bodies of a URL's records, each by one range read."""
        out = []
        for _, _, path, offset, size in self.captures(url):
            with opened(path) as file:
                file.seek(int(offset))
                out.append(parse(zlib.decompress(file.read(int(size)), _GZIP)))
        return out


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_records(directory: DataFrame) -> DataFrame:
    """Every indexed record by its byte range, with its payload's length and digest computed from what was read.

    A revisit has no payload of its own; its length and digest are those its head gives. Lines of a block are read in
    the order of archive and offset.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, file, open_path = [], io.BytesIO(), None
                for _, page_id, path, offset, size in sorted(block_lines_at(*block), key=lambda x: (x[2], int(x[3]))):
                    if path != open_path:
                        file.close()
                        file, open_path = opened(path), path
                    file.seek(int(offset))
                    fields, body = parse(zlib.decompress(file.read(int(size)), _GZIP))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest != (seen := digest_of(body)):
                        raise ValueError(f"payload of page {page_id} has digest {seen}, not {digest}")
                    length = len(body) if kind == "response" else int(fields["WARC-Payload-Length"])
                    rows.append((int(page_id) if page_id else None, length, digest, kind, _id(fields.get("WARC-Refers-To"))))
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORDS, strict=True)], schema=_RECORDS)

    return directory.select("path", "offset", "length").repartition(partitions(directory)).mapInArrow(run, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write(pages(spark, sf_dir), shared_dir(spark, "warc"))
    return read_records(build_index(captures(archives), shared_dir(spark, "warc-index")))


#: The same from the table alone: payload lengths, base32 of SHA-1, and the smallest page of each payload.
OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
           (('0x' || substr(h, 1 + ((5 * i) // 20) * 5, 5))::BIGINT >> (15 - (5 * i) % 20)) & 31)::BIGINT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
