"""Token ids in binary files with Elias-Fano document boundaries.

A file holds a range of documents in id order: a head, the document ids, the Elias-Fano code of where each document
ends, then all token ids in one array of 16 or 32 bits. A manifest row per file tells how many ids lie before it, so
that offsets are global. `TokenFile` finds a document's ids by two selects and one range read.

Files go to the shared folder under a name of their own for each attempt; only those of attempts that ended are in
the manifest, so lost executors and repeated tasks leave no doubles.

Defined cases: null text counts as empty and holds the end id alone; repeated rows keep a document each; a null
doc_id sorts last and comes back null; an empty table gives no files and an empty result; a text of more than FILE_IDS ids is
a file of its own; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_text, materialize, shared_dir, slices
from .elias_fano import EliasFano
from .words import library_encoder, public_path

MAGIC = b"TWIDS\x01\0\0"
_HEAD = struct.Struct("<8sqqqqq")  # magic, documents, nulls at the end, ids, bytes an id, bytes of boundaries
END_ID = 2
MANIFEST = "place int, number int, path string, n_docs long, n_ids long"
#: Ids of a file, of four bytes each in memory.
FILE_IDS = 1 << 24


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_file(path: str, doc_ids: list[int | None], ends: list[int], ids: list[bytes], top: int) -> None:
    """One file; ids are little-endian unsigned 32-bit arrays of each document, doc_ids ascend with nulls last."""
    width = 2 if top < 1 << 16 else 4
    n_ids = ends[-1] if ends else 0
    code = EliasFano.encode(np.array(ends, np.int64), n_ids).to_bytes()
    known = [i for i in doc_ids if i is not None]
    system, name = place_of(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as out:
        out.write(_HEAD.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), n_ids, width, len(code)))
        out.write(np.array(known, "<i8").tobytes())
        out.write(code)
        for at in range(0, len(ids), 4096):
            block = b"".join(ids[at : at + 4096])
            out.write(np.frombuffer(block, "<u4").astype("<u2").tobytes() if width == 2 else block)


class TokenFile:
    """Random access to a file of this format."""

    def __init__(self, path: str) -> None:
        system, name = place_of(path)
        self.file = system.open_input_file(name)
        magic, self.n_docs, self.nulls, self.n_ids, self.width, code = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        known = self.n_docs - self.nulls
        self.doc_ids: list[int | None] = [*np.frombuffer(self.file.read(8 * known), "<i8").tolist(), *[None] * self.nulls]
        self.ends = EliasFano.from_bytes(self.file.read(code))
        self.start = _HEAD.size + 8 * known + code

    def span(self, k: int) -> tuple[int, int]:
        """Where the k-th document's ids start and end in this file."""
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def read(self, start: int, end: int) -> np.ndarray:
        self.file.seek(self.start + self.width * start)
        return np.frombuffer(self.file.read(self.width * (end - start)), f"<u{self.width}").astype("<u4")

    def ids(self, k: int) -> np.ndarray:
        return self.read(*self.span(k))

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, most: int = FILE_IDS) -> DataFrame:
    """Write all documents in id order; returns the manifest, a row per file.

    Documents are dealt into ranges of ids. A range's files end after `most` ids, so a task holds no more, whatever the
    size of the range; only a document of more ids makes a larger file, of its own.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = id_text(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = pa.schema([("place", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, attempt = library_encoder(tokenizer_path), TaskContext.get().partitionId(), uuid.uuid4().hex
        doc_ids, ends, ids, number = [], [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{place:06d}-{number:06d}-{attempt}.ids"
            write_file(path, doc_ids, ends, ids, max(encoder.top, end_id))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((place, number, path, len(doc_ids), ends[-1]), schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch, 1024):
                for i, x in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    size, total = len(x) // 4 + 1, ends[-1] if ends else 0
                    if ends and total + size > most:
                        yield close()
                        doc_ids, ends, ids, number, total = [], [], [], number + 1, 0
                    doc_ids.append(i)
                    ends.append(total + size)
                    ids += (x, end)
        if doc_ids:
            yield close()

    return materialize(rows.mapInArrow(run, MANIFEST), "token-manifest")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_back(manifest: DataFrame) -> DataFrame:
    """Global start, length and checksum of each document, from the files of a manifest (a row per file)."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("place", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("place", "number", "path", before.alias("before"))  # a row for each file
    n = max(1, min(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count()))
    listed = files.repartition(n, "path").select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                for first in range(0, file.n_docs, 1024):
                    ks = range(first, min(first + 1024, file.n_docs))
                    ends = [file.span(first)[0], *(file.ends.select(k) for k in ks)]
                    spans = list(zip(ends, ends[1:], strict=False))
                    data = file.read(ends[0], ends[-1]).tobytes()
                    cut = [data[4 * (s - spans[0][0]) : 4 * (e - spans[0][0])] for s, e in spans]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(file.doc_ids[ks.start : ks.stop], pa.int64()),
                            pa.array([before + s for s, _ in spans], pa.int64()),
                            pa.array([e - s for s, e in spans], pa.int64()),
                            pa.array([zlib.crc32(x) for x in cut], pa.int64()),
                        ],
                        schema=_READ,
                    )
                file.close()

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write(documents(spark, sf_dir), public_path(), shared_dir(spark, "token-files")))
