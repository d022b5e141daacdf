"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has a bit set if more than half of the 64-bit hashes of its shingles have it. Two
fingerprints link if they differ in at most DISTANCE bits. Equal fingerprints meet first, so that copies cost nothing
more. Distinct fingerprints are dealt out by the exact value of each of DISTANCE + 1 bit blocks: two that link agree
on at least one. Each task sorts its fingerprints by Gray rank and builds an index over runs of neighbours: a node
keeps the bits that all below it share, less those of its parent. A self-join goes down pairs of nodes, adds up the
differences of newly shared bits and drops a pair of groups once they exceed DISTANCE.

A task emits a spanning forest of its links, never all pairs. A block value with more fingerprints than GROUP is dealt
out again by blocks of the remaining bits, so that no task gets an unbounded group.

Defined cases: null text and texts without words have fingerprint zero and link like any other; fewer words than a
shingle count as one shingle of all of them; repeated rows keep a row each, and
rows that repeat an id are one document, so their texts link; a row without an id keeps its row, links only by its
fingerprint, and has the smallest id of its component, null if there is none; a very long text is counted in blocks; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_text, map_batches, materialize, slices
from .components import components

WORDS = 3
DISTANCE = 2
SEED = 42
#: Most fingerprints that one block value may bring to a task before it is split by further bits.
GROUP = 1 << 20
#: Children of an index node.
FAN = 8
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16
#: Node pairs looked at in one step.
_PAIRS = 1 << 18


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint of a text: A-Z lower-cased, words of anything but ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    data = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    stops = (ends - 1).tolist()[words - 1 :] or [len(data)]
    digest, n = xxhash.xxh64_intdigest, len(stops)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        some = np.array([digest(data[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=False)], "<u8")
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * set_bits > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long); no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(t, words) for part in slices(batch) for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], schema=schema)

    return map_batches(id_text(docs), one, "doc_id long, fp long")


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence."""
    v = v.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(shift)
    return v


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; level 0 is the fingerprints themselves."""

    def __init__(self, fps: np.ndarray) -> None:
        self.order = np.argsort(gray_rank(fps), kind="stable")
        everything = np.uint64(0xFFFFFFFFFFFFFFFF)
        value = fps[self.order]
        mask = np.full(len(value), everything)
        levels = [(value, mask)]
        while len(value) > 1:
            at = np.arange(0, len(value), FAN)
            ones = np.bitwise_and.reduceat(value & mask, at)
            zeros = np.bitwise_and.reduceat(~value & mask, at)
            value, mask = ones, ones | zeros
            levels.append((value, mask))
        # what a node keeps is what its parent doesn't have already
        self.levels = []
        for k, (value, mask) in enumerate(levels):
            own = mask if k + 1 == len(levels) else mask & ~np.repeat(levels[k + 1][1], FAN)[: len(mask)]
            self.levels.append((value, mask, own))

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in the given order that differ in at most `distance` bits, in blocks."""
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        stack = [(top, zero, zero, np.zeros(1, np.uint8))]
        while stack:
            level, a, b, gone = stack.pop()
            if level == 0:
                yield self.order[a], self.order[b]
                continue
            if len(a) * FAN * FAN > _PAIRS and len(a) > 1:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half], gone[:half]), (level, a[half:], b[half:], gone[half:])]
                continue
            value, mask, own = self.levels[level - 1]
            _, upper, _ = self.levels[level]
            step = np.arange(FAN)
            x = (a[:, None, None] * FAN + step[None, :, None]).repeat(FAN, axis=2).ravel()
            y = (b[:, None, None] * FAN + step[None, None, :]).repeat(FAN, axis=1).ravel()
            before = gone.repeat(FAN * FAN)
            seen = (upper[a] & upper[b]).repeat(FAN * FAN)
            keep = (x < len(value)) & (y < len(value)) & ((x < y) if level == 1 else (x <= y))
            x, y, before, seen = x[keep], y[keep], before[keep], seen[keep]
            fresh = mask[x] & mask[y] & ~seen
            total = before + np.bitwise_count((value[x] ^ value[y]) & fresh)
            keep = total <= distance
            if keep.any():
                stack.append((level - 1, x[keep], y[keep], total[keep]))


def forest(fps: np.ndarray, nodes: np.ndarray, distance: int) -> np.ndarray:
    """The smallest node of each fingerprint's group, where groups are the linked fingerprints of this array."""
    label = nodes.copy()
    parent = np.arange(len(fps))

    def roots(x: np.ndarray) -> np.ndarray:
        while (up := parent[x]) is not None and (up != x).any():
            parent[x] = parent[up]
            x = up
        return x

    for a, b in GrayIndex(fps).links(distance):
        while len(a):  # hook the larger root below the smaller one until all of these pairs have one root
            x, y = roots(a), roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    top = roots(np.arange(len(fps)))
    np.minimum.at(label, top, nodes)
    return label[top]


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """Bit places cut into n runs of nearly equal size."""
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def _mask(bits: list[int]) -> int:
    """As a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def deal(nodes: DataFrame, distance: int, group: int) -> DataFrame:
    """(deal, key, fp, node): each fingerprint once for each block, hot block values dealt out again.

    Two fingerprints that link share at least one (deal, key).
    """
    done: list[DataFrame] = []

    def split(df: DataFrame, name: str, bits: list[int], depth: int) -> None:
        parts = blocks(bits, distance + 1)
        cells = F.array(*(F.struct(F.lit(f"{name}{i}").alias("deal"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for i, p in enumerate(parts)))
        spread = df.select("fp", "node", *(["key"] if depth else []), F.explode(cells).alias("cell"))
        key = F.concat_ws("/", *([F.col("key")] if depth else []), F.col("cell.key").cast("string"))
        spread = spread.select(F.col("cell.deal").alias("deal"), key.alias("key"), "fp", "node")
        hot = spread.groupBy("deal", "key").count().where(F.col("count") > group)
        names = {r["deal"] for r in hot.select("deal").distinct().collect()} if len(bits) - max(map(len, parts)) > 2 * distance else set()
        if not names:
            done.append(spread)
            return
        hot = materialize(hot.select("deal", "key"), "hot")
        few = hot.count() <= 100_000
        side = F.broadcast(hot) if few else hot
        done.append(spread.join(side, ["deal", "key"], "left_anti"))
        for i, part in enumerate(parts):
            if f"{name}{i}" in names:
                again = spread.where(F.col("deal") == f"{name}{i}").join(side, ["deal", "key"], "left_semi")
                split(again, f"{name}{i}.", [b for b in bits if b not in part], depth + 1)

    split(nodes, "", list(range(64)), 0)
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def links(nodes: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between nodes of distinct fingerprints that join all that differ in at most `distance` bits.

    nodes: fp, node (two longs), one row per fingerprint. Each task indexes all its block values at once: their bits
    differ high up in the index, where pairs of groups drop out.
    """
    dealt = deal(nodes, distance, group)
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "deal", "key").select("fp", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, ids = [], []
        for batch in batches:
            fps.append(batch.column(0).to_numpy())
            ids.append(batch.column(1).to_numpy())
        if not fps:
            return
        fp, first = np.unique(np.concatenate(fps).view(np.uint64), return_index=True)
        node = np.concatenate(ids)[first]
        low = forest(fp, node, distance)
        keep = low != node
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(low[keep])], schema=schema)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint in hex and component_id (smallest doc_id reachable) of every document.

    A fingerprint is a node of its own number, itself; fingerprints of one doc_id are links as well.
    """
    found = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("low")).withColumn("node", F.col("fp")), "nodes")
    several = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("doc_id", "a")
    of_one = found.join(several, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    same = materialize(components(links(nodes.select("fp", "node"), distance).unionByName(of_one)), "components")
    linked = nodes.join(same, "node")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = nodes.join(linked.join(lowest, "component").select("fp", "component_id", F.lit(True).alias("linked")), "fp", "left")
    classes = classes.select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    return found.join(classes, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
