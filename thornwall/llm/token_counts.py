"""Token counts of the sections of documents, by offset-mapped attribution.

A document is encoded once, as a whole. The character span of each token is then joined with the spans of the
document's sections, both sorted. A token belongs to the section that holds most of its characters, the earlier one
on ties; `boundary` counts the tokens that reach across a section's end or start and went to it. So the sections'
counts add up to the document's.

Sections are lines, each with its line feed: they cover the text without gaps. Any other sorted cover does as well.

The byte-level tokenizer cuts a text by a pattern before any merge, so a text's spans are those of its pieces, shifted;
pieces are kept in a bounded table of a Python worker and only new ones are encoded by the library.

Defined cases: null and empty texts have one empty section with no tokens; the end-of-text marker in a text is
ordinary text; repeated rows keep their own sections; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text, slices
from .words import beyond_plane, plane_classes, public_path

TOKENIZER = "byte_bpe_50k.json"
MAX_PIECES = 600_000
#: The tokenizer's own pattern: a fixed value of its format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
_RUNS = "'(?:s|t|re|ve|m|ll|d)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_ASCII_PIECES = re.compile(_RUNS.format(L="a-zA-Z", N="0-9", S=r"\x09-\x0d\x20"))


@cache
def _plane_pieces() -> re.Pattern[str]:
    return re.compile(_RUNS.format(**plane_classes()))


def pieces_of(text: str) -> list[str]:
    return (_ASCII_PIECES if text.isascii() else _PIECES if beyond_plane(text) else _plane_pieces()).findall(text)


class SpanEncoder:
    """Character spans of the tokens of texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} isn't a plain byte-level tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Piece to the starts and ends of its tokens, in turn, as little-endian unsigned 32-bit numbers.
        self.table: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 2000):
            some = pieces[at : at + 2000]
            for piece, found in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                self.table[piece] = b"".join(pack("<II", a, b) for a, b in found.offsets)

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """For each text an array (tokens, 2) of character starts and ends, in order."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            cut = [pieces_of(t) for t in texts]
            new = set(chain.from_iterable(cut))
            if len(self.table) + len(new) > MAX_PIECES:
                self.table.clear()
            self._learn(list(new.difference(self.table)))
            get, out = self.table.__getitem__, []
            for pieces in cut:
                if not pieces:
                    out.append(np.zeros((0, 2), np.int64))
                    continue
                own = list(map(get, pieces))
                ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
                counts = np.fromiter(map(len, own), np.int64, len(own)) // 8
                shift = np.repeat(np.concatenate([[0], ends[:-1]]), counts)
                out.append(np.frombuffer(b"".join(own), "<u4").reshape(-1, 2) + shift[:, None])
            return out
        finally:
            if collecting:
                gc.enable()


_ENCODERS: dict[str, SpanEncoder] = {}


def encoder(path: str) -> SpanEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SpanEncoder(path)
    return _ENCODERS[path]


def line_starts(text: str) -> np.ndarray:
    """Where each line starts; a line feed ends its line, and nothing follows the last one."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    starts = np.concatenate([[0], ends])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(text) else starts


def attribute(spans: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary tokens of each section, for sorted sections that cover [0, length)."""
    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 1] - 1, spans[:, 0]), "right") - 1
    owner, across = first.copy(), np.flatnonzero(last > first)
    ends = np.concatenate([starts[1:], [length]])
    for i in across:
        a, b = spans[i]
        parts = np.minimum(ends[first[i] : last[i] + 1], b) - np.maximum(starts[first[i] : last[i] + 1], a)
        owner[i] = first[i] + int(parts.argmax())
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[across], minlength=n)


COUNTS = "doc_id long, section int, start long, length long, n_tokens long, boundary long"
_COUNTS = pa.schema([("doc_id", pa.int64()), ("section", pa.int32())] + [(n, pa.int64()) for n in ("start", "length", "n_tokens", "boundary")])


def count_sections(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """A row for each line of each document: its span and its tokens; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, sections, starts, lengths, tokens, bounds = [], [], [], [], [], []
                for i, text, spans in zip(part.column(0).to_pylist(), texts, own.spans(texts), strict=True):
                    at = line_starts(text)
                    n, crossing = attribute(spans, at, len(text))
                    ids += [i] * len(at)
                    sections.append(np.arange(len(at), dtype=np.int32))
                    starts.append(at)
                    lengths.append(np.diff(at, append=len(text)))
                    tokens.append(n)
                    bounds.append(crossing)
                columns = [pa.array(ids, pa.int64()), *(pa.array(np.concatenate(c), f.type) for c, f in zip((sections, starts, lengths, tokens, bounds), list(_COUNTS)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)

    return id_text(docs).mapInArrow(run, COUNTS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_sections(documents(spark, sf_dir), public_path(TOKENIZER))
