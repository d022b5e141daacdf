"""BPE encoding and decoding without a tokenizer library.

A piece is a doubly linked list of symbols. Merges wait in a priority queue by rank and place; an entry is stale, and
skipped, if one of its two symbols has changed since. Decoding concatenates vocabulary strings, with a space between
tokens as the file names no decoder.

Defined cases: null and blank texts have no ids and decode to the empty text; special tokens in a text become their
ids; repeated rows keep a row each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text, slices
from .words import END, WordEncoder, public_path, read_spec


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merger:
    """Merges of the symbols of one piece."""

    def __init__(self, spec: dict) -> None:
        vocab = spec["model"]["vocab"]
        names = byte_symbols()
        self.first = [vocab[n] for n in names]
        self.last = [vocab[n + END] for n in names]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (rank, vocab[a + b])

    def __call__(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, rank = len(ids), self.rank
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, merged, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # stale
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((merged, ids[k])):
                    heapq.heappush(queue, (*found, i, merged, ids[k]))
            if (h := before[i]) >= 0 and (found := rank.get((ids[h], merged))):
                heapq.heappush(queue, (*found, h, ids[h], merged))
        return [x for x in ids if x >= 0]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = read_spec(path)
        merge = Merger(spec)
        self.encoder = WordEncoder(spec, lambda pieces: (np.array(merge(p), "<u4").tobytes() for p in pieces))
        strings = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoder.encode(texts)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and its ids (array of int); no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = codec(path).encode([t or "" for t in part.column(1).to_pylist()])
                ids = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], schema=schema)

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


_ROUND = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Counts and hashes of each text's ids and of what they decode to; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch):
                found = own.encode([t or "" for t in part.column(1).to_pylist()])
                columns = (
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in found], pa.string()),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=_ROUND)

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_path())
