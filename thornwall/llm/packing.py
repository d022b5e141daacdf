"""Best-fit decreasing packing of token sequences.

Pieces go in order of decreasing length into the open bin with the least room that still takes them, which a segment
tree over remaining capacities finds in logarithmic time. Pieces of one length are alike, so the driver places them
together: what it needs of the corpus is how many pieces there are of each length (at most `size` numbers), and what it
makes is a plan of runs, "ranks a to b of length L go k to a bin, into bins from s on". The result is the one that
placing piece by piece would give. Executors then look their pieces up in the plan by length and rank.

Defined cases: null text counts as empty and holds the separator alone; texts that are too long are cut into full
pieces and a shorter last one; repeated rows are packed once each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_text, materialize, slices
from .words import library_encoder, public_path

SIZE = 2048
SEPARATOR = 0
#: Rows of the table of (task, length) starts up to which it is broadcast; beyond that it is joined by a shuffle.
BROADCAST_STARTS = 200_000


class CapacityTree:
    """Segment tree over capacities 0..size: how many open bins have each; finds the tightest that fits."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.has = np.zeros(2 * self.leaves, np.bool_)

    def put(self, capacity: int, open_: bool) -> None:
        i = self.leaves + capacity
        self.has[i] = open_
        while i > 1:
            i >>= 1
            self.has[i] = self.has[2 * i] or self.has[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is at least `least`."""
        i = self.leaves + least
        if self.has[i]:
            return least
        while i > 1:
            if not i & 1 and self.has[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.has[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces a bin, first bin, place in the bin), by length and first rank.

    Rank r of a run goes into bin first_bin + (r - first) // each, at place + ((r - first) % each) * length.
    """
    tree, bins, new, runs = CapacityTree(size), defaultdict(deque), 0, []

    def give(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            bins[capacity].append((first, n))
            tree.put(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = size, new, -(-left // (size // length))
                new += n
            else:
                first, n = bins[room].popleft()
                if not bins[room]:
                    tree.put(room, False)
            each = room // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            runs.append((length, rank, each, first, size - room))
            full = placed // each
            give(room - each * length, first, full)
            if placed % each:
                give(room - placed % each * length, first + full, 1)
            if used < n:
                bins[room].appendleft((first + used, n - used))
                tree.put(room, True)
            rank, left = rank + placed, left - placed
    return runs


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, rank long"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]
)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """Every piece with its checksum and its rank among the pieces of its length in its task; no shuffle."""
    end = struct.pack("<I", separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for part in slices(batch, 1024):
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[at : at + 4 * size]
                        n = len(own) // 4
                        rows.append((i, k, at // 4, n, zlib.crc32(own), task, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return id_text(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """sequence_id and offset of every piece."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, size, separator), "pieces")
    per_task = materialize(cut.groupBy("task", "length").count(), "lengths")
    runs = plan({r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}, size)
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("task", "length", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))
    ranked = cut.join(F.broadcast(starts) if per_task.count() <= BROADCAST_STARTS else starts, ["task", "length"])
    by_length: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    for length, first, each, bin_, place in runs:
        own = by_length.setdefault(length, ([], []))
        own[0].append(first)
        own[1].append((each, bin_, place))
    shared = spark.sparkContext.broadcast(by_length)

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        plan_, bins, offsets = shared.value, [], []
        for n, r in zip(length.tolist(), rank.tolist(), strict=True):
            firsts, found = plan_[n]
            k = bisect_right(firsts, r) - 1
            each, bin_, at = found[k]
            q, m = divmod(r - firsts[k], each)
            bins.append(bin_ + q)
            offsets.append(at + m * n)
        return pd.DataFrame({"sequence_id": pd.Series(bins, dtype="int64"), "offset": pd.Series(offsets, dtype="int64")})

    placed = ranked.withColumn("at", F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("rank") + F.col("before")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_path())
