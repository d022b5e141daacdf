"""Document fingerprints: quartile bucket digests.

Byte triplets of a sliding five-byte window are hashed into BUCKETS counters; a digest holds the quartile of each
counter (two bits) and a logarithmic length (one byte), in hex. Two digests are compared by the sum of quartile
differences and a bounded length difference, scaled to a likeness from 0 to 1.

Defined cases: null text counts as empty; a text under three bytes has the all-zero body; equal texts always have
equal digests; repeated rows keep a row each (their order among themselves is by a hash of the text); the only
document of a table is its own next document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text
from .ordered import bounds, partitions, range_of

BUCKETS = 512
#: Offsets of the second and third byte of a triplet in the window.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
MULTIPLIER = np.uint32(2654435761)
MAX_LENGTH_STEPS = 64
LENGTH_WEIGHT = 4
_SHIFT = np.uint32(32 - (BUCKETS.bit_length() - 1))
_BLOCK = 1 << 20
_WORST = 3 * BUCKETS + LENGTH_WEIGHT * MAX_LENGTH_STEPS


def codes(data: bytes) -> np.ndarray:
    """Length code and the BUCKETS quartile codes, as small integers."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    count = np.zeros(BUCKETS, np.int64)
    for salt, (i, j) in enumerate(TRIPLETS):
        for at in range(0, max(0, len(b) - j), _BLOCK):  # blocks bound the memory of very long texts
            n = min(_BLOCK, len(b) - j - at)
            v = b[at : at + n] | (b[at + i : at + i + n] << np.uint32(8)) | (b[at + j : at + j + n] << np.uint32(16))
            v = (v + np.uint32(salt << 24)) * MULTIPLIER >> _SHIFT
            count += np.bincount(v, minlength=BUCKETS)
    ranked = np.sort(count)
    cuts = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    body = (count[:, None] > cuts).sum(axis=1)
    length = min(255, int(round(8 * np.log2(len(data) + 1))))
    return np.concatenate([[length], body]).astype(np.int16)


def digest(code: np.ndarray) -> str:
    body = code[1:].reshape(-1, 4)
    return bytes([code[0]]).hex() + (body @ np.array([64, 16, 4, 1])).astype(np.uint8).tobytes().hex()


def parse(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.concatenate([raw[:1], ((raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel()]).astype(np.int16)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """1 for equal digests, 0 for the largest difference."""
    diff = np.abs(x - y)
    return 1.0 - (int(diff[1:].sum()) + LENGTH_WEIGHT * min(int(diff[0]), MAX_LENGTH_STEPS)) / _WORST


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(codes((t or "").encode("utf-8", "surrogatepass"))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64())]
    + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [(n, pa.float64()) for n in ("near_edited", "near_next")]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range and position; the last of each range is a copy of the head of the next range."""
    before, rows = None, []
    for batch in batches:
        for place, copy, i, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            text = text or ""
            code = codes(text.encode("utf-8", "surrogatepass"))
            if before and before[0] == place:
                _, j, own, mine = before
                k = len(own) // 2
                edited = (own[: len(own) - k] + text[:k]).encode("utf-8", "surrogatepass")
                other = codes(edited)
                rows.append((j, len(own), hashlib.sha256(edited).hexdigest(), digest(mine), digest(other), likeness(mine, other), likeness(mine, code)))
            before = None if copy else (place, i, text, code)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
            rows = []


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text, in descending id order.

    The texts are shuffled once, by range. The head of each range (ids only, one per range) is found first and its
    row goes to the range before as well, so no range needs another one's rows. A null id counts as the largest.
    """
    n = partitions(docs)
    rows = id_text(docs).withColumn("up", F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1)))).withColumn("tie", F.xxhash64("text"))
    keys = rows.select("up", "tie")
    cuts = bounds(keys, n, docs.count())
    rows = rows.withColumn("place", range_of(F.col("up"), F.col("tie"), cuts))
    heads = sorted(
        (r["place"], r["head"]["up"], r["head"]["tie"])
        for r in keys.withColumn("place", range_of(F.col("up"), F.col("tie"), cuts)).groupBy("place").agg(F.min(F.struct("up", "tie")).alias("head")).collect()
    )  # one row per range
    before = [(up, tie, heads[k - 1][0]) for k, (_, up, tie) in enumerate(heads)]
    copies = docs.sparkSession.createDataFrame(before, "up long, tie long, to int")
    heads_of = rows.join(F.broadcast(copies), ["up", "tie"]).dropDuplicates(["up", "tie"])
    both = rows.select("place", F.lit(False).alias("copy"), "doc_id", "text", "up", "tie").unionByName(
        heads_of.select(F.col("to").alias("place"), F.lit(True).alias("copy"), "doc_id", "text", "up", "tie")
    )
    dealt = both.repartitionById(n, "place").sortWithinPartitions("place", "copy", "up", "tie")
    return dealt.select("place", "copy", "doc_id", "text").mapInArrow(_compare, COMPARED)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
