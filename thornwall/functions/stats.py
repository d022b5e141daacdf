"""Text statistics that run vectorised in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from importlib.resources import files

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = 27
_SYMBOL = np.full(256, SYMBOLS - 1, np.int64)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(26)
_SYMBOL[ord("A") : ord("Z") + 1] = np.arange(26)
#: Fixed values of 64-bit FNV-1a.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def train(corpus: str) -> np.ndarray:
    """Natural logarithms of how likely each symbol follows each other, from pair counts plus one."""
    s = _SYMBOL[np.frombuffer(corpus.encode(), np.uint8)]
    counts = np.ones((SYMBOLS, SYMBOLS))
    np.add.at(counts, (s[:-1], s[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def corpus() -> str:
    """The prose that the model learns from: its lines, each with a line feed."""
    return (files("thornwall") / "data" / "prose.txt").read_text(encoding="utf-8")


@cache
def model() -> np.ndarray:
    return train(corpus())


def score(text: str, table: np.ndarray | None = None) -> float | None:
    """Mean surprise of a byte pair in nats; None below two bytes."""
    s = _SYMBOL[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    if len(s) < 2:
        return None
    return float(-(model() if table is None else table)[s[:-1], s[1:]].mean())


def entropy(text: str) -> float:
    """Shannon entropy of the characters in bits."""
    if not text:
        return 0.0
    _, n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def fnv1a64(data: bytes, h: int = FNV_START) -> int:
    """FNV-1a of some bytes, or of those that follow what has the hash h."""
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


#: Values up to which the rest of a batch is hashed one by one.
FEW = 8


def fnv1a64_all(values: Sequence[bytes]) -> np.ndarray:
    """fnv1a64 of each value: the first byte of all, then the second, and so on; the FEW longest end one by one."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-sizes, kind="stable")
    data, at = np.frombuffer(b"".join(values), np.uint8), (np.cumsum(sizes) - sizes)[order]
    hashes, prime, done = np.full(len(values), FNV_START, np.uint64), np.uint64(FNV_PRIME), 0
    shorter = np.sort(sizes)
    while (left := len(values) - int(np.searchsorted(shorter, done, "right"))) > FEW:
        hashes[:left] = (hashes[:left] ^ data[at[:left] + done]) * prime
        done += 1
    out = np.empty(len(values), np.uint64)
    out[order] = hashes
    for i in order[:left]:
        out[i] = fnv1a64(values[i][done:], int(out[i]))
    return out


#: Characters of texts whose tokens exist at a time.
SLICE = 1 << 20


def simhashes(texts: Sequence[str]) -> np.ndarray:
    """64-bit SimHash of the tokens of each normalised text: a bit is set if most tokens have it. Memory is bounded by SLICE or one text."""
    out, at = np.zeros(len(texts), np.uint64), 0
    while at < len(texts):
        end, size = at, 0
        ids: dict[str, int] = {}
        rows: list[list[int]] = []
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
            rows.append([ids.setdefault(token, len(ids)) for token in texts[end].split()])
            size, end = size + len(texts[end]), end + 1
        counts = np.array([len(r) for r in rows])
        some = np.flatnonzero(counts)  # a text without tokens has no bit
        if len(some):
            hashes = fnv1a64_all([token.encode("utf-8", "surrogatepass") for token in ids])
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            tokens = bits[np.concatenate([rows[i] for i in some])]
            ones = np.add.reduceat(tokens, np.cumsum(counts[some]) - counts[some], axis=0, dtype=np.int64)
            most = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little")
            out[at + some] = most.view("<u8")[:, 0]
        at = end
    return out


def simhash(normalised: str) -> int:
    return int(simhashes([normalised])[0])


def _statistics(s: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else (entropy(t), score(t)) for t in s]
    return pd.DataFrame(rows, columns=["bits", "nats"])


def statistics(text: Column) -> Column:
    """Entropy in bits and surprise in nats, in one pass; null texts cost nothing."""
    return F.pandas_udf(_statistics, "struct<bits:double,nats:double>")(text)


def _simhash(s: pd.Series) -> pd.Series:
    there = s.notna().to_numpy()
    out = np.zeros(len(s), np.int64)
    out[there] = simhashes(s[there].tolist()).view(np.int64)
    return pd.Series(pd.arrays.IntegerArray(out, ~there))


def simhash_column(normalised: Column) -> Column:
    return F.pandas_udf(_simhash, "bigint")(normalised)
