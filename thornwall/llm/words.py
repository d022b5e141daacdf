"""Piece-wise encoding for tokenizers that cut a text before any merge happens.

The 49k word tokenizer normalises to NFC and lower case, drops white space and cuts the rest by a pattern. So the ids
of a text are those of its pieces one after another. The ids of pieces are kept in a bounded table of a Python
worker; only pieces that are new get encoded.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import regex

TOKENIZER = "word_bpe_49k.json"
#: Most pieces in the table, and most characters of one that stays there (about 220 MB in all). A full table starts again.
MAX_PIECES = 1_000_000
MAX_PIECE = 256

#: What the tokenizer file must say for piece-wise encoding to equal encoding at once: fixed values of its format.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
END = "</w>"

#: The pattern with its first alternatives joined; the order of the others doesn't matter, as no two share a first character.
_PIECES = regex.compile(r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|[^\p{White_Space}\p{L}\p{N}]+|\p{N}")
_ASCII_PIECES = re.compile(r"[a-zA-Z]+|'(?:s|t|re|ve|m|ll|d)|[^\x09-\x0d\x20a-zA-Z0-9]+|[0-9]")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def plane_classes() -> dict[str, str]:
    """Ranges of letters L, numbers N and white space S below code point 65,536, for a character class.

    There the re module keeps classes as bit maps, which is faster than looking up properties.
    """
    kinds = {"L": "", "N": "", "S": r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"}
    start, last = 0, ""
    for c in range(0x10001):
        kind = unicodedata.category(chr(c))[0] if c < 0x10000 else ""
        if kind != last:
            if last in ("L", "N"):
                kinds[last] += f"\\u{start:04x}-\\u{c - 1:04x}"
            start, last = c, kind
    return kinds


@cache
def _plane_pieces() -> re.Pattern[str]:
    return re.compile("[{L}]+|'(?:s|t|re|ve|m|ll|d)|[^{S}{L}{N}]+|[{N}]".format(**plane_classes()))


def beyond_plane(text: str) -> bool:
    return _ASTRAL.search(text) is not None


def pieces_of(text: str) -> list[str]:
    """The pieces of a text without special tokens: NFC, lower case letter by letter (no special final sigma), cut."""
    if text.isascii():
        return _ASCII_PIECES.findall(text.lower())
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ").lower()
    return (_PIECES if beyond_plane(text) else _plane_pieces()).findall(text)


def public_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_spec(path: str) -> dict:
    """The tokenizer file as data, after checking that it is of the kind this module can encode."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    if kinds != NORMALIZERS or steps[0].get("pattern", {}).get("Regex") != SPLIT_PATTERN or spec["model"].get("end_of_word_suffix") != END:
        raise ValueError(f"{path} isn't a tokenizer of lower-case words")
    return spec


class WordEncoder:
    """Texts to ids. `encode_pieces` turns a list of new pieces into the ids of each, as bytes."""

    def __init__(self, spec: dict, encode_pieces: Callable[[list[str]], Iterable[bytes]]) -> None:
        self.encode_pieces = encode_pieces
        self.top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.table: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        """The text cut at special tokens, which take the odd places."""
        return self._cut.split(text) if self._cut and "<|" in text else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # many small lists and no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._parts(t) for t in texts]
        get = self.table.get
        new: dict[str, int] = {}  # pieces that the table lacks, numbered
        gaps: list[tuple[list[bytes | None], int, int]] = []  # where which of them goes
        known = []
        for parts in cut:
            own = []
            for part in parts[::2]:
                pieces = pieces_of(part)
                ids = list(map(get, pieces))
                at = -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    gaps.append((ids, at, new.setdefault(pieces[at], len(new))))
                own.append(ids)
            known.append(own)
        if len(self.table) + len(new) > MAX_PIECES:
            self.table.clear()
        if new:
            found = list(self.encode_pieces(list(new)))
            self.table.update((p, ids) for p, ids in zip(new, found, strict=True) if len(p) <= MAX_PIECE)
            for where, at, number in gaps:
                where[at] = found[number]
        out = []
        for parts, own in zip(cut, known, strict=True):
            data = b"".join(own[0])
            for special, ids in zip(parts[1::2], own[1:], strict=True):
                data += self.special[special].to_bytes(4, "little") + b"".join(ids)
            out.append(data)
        return out


def library_pieces(path: str, spec: dict) -> Callable[[list[str]], list[bytes]]:
    """Encoding of pieces by the tokenizers library, many in one call, cut apart at word ends."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    ends = np.zeros(tokenizer.get_vocab_size(), np.bool_)
    ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(END)]] = True

    def run(pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), 500):
            some = pieces[at : at + 500]
            ids = tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids
            data = np.array(ids, "<u4").tobytes()
            cuts = (4 * np.flatnonzero(ends[ids]) + 4).tolist()
            if len(cuts) == len(some) and cuts[-1] == len(data):
                out += [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
            else:
                out += [np.array(tokenizer.encode(p, add_special_tokens=False).ids, "<u4").tobytes() for p in some]
        return out

    return run


_ENCODERS: dict[tuple[str, str], WordEncoder] = {}


def library_encoder(path: str) -> WordEncoder:
    """This worker's encoder over the tokenizers library."""
    if ("library", path) not in _ENCODERS:
        spec = read_spec(path)
        _ENCODERS["library", path] = WordEncoder(spec, library_pieces(path, spec))
    return _ENCODERS["library", path]
