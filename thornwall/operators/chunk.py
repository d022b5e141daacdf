"""Overlapping windows of bytes that never cut a character."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ascii

SIZE, OVERLAP = 2048, 256
STRIDE = SIZE - OVERLAP
WINDOWS = "array<struct<start:bigint,end:bigint>>"
SLICES = "array<struct<start:bigint,end:bigint,text:string>>"


def windows_of(data: bytes) -> list[dict[str, int]]:
    """Spans of a text's windows: ends move left and starts move right off the inside of a character."""
    n, start, out = len(data), 0, []
    while start < n:
        end = min(start + SIZE, n)
        while end < n and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append({"start": start, "end": end})
        if end == n:
            break
        start = end - OVERLAP
        while start < n and data[start] & 0xC0 == 0x80:
            start += 1
    return out


def _other_windows(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else windows_of(t.encode("utf-8", "surrogatepass")))


def plain_windows(text: Column) -> Column:
    """Array of window spans of an ASCII text, in closed form."""
    n = F.octet_length(text).cast("bigint")
    count = F.when(n <= SIZE, F.lit(1).cast("bigint")).otherwise(1 + F.ceil((n - SIZE) / STRIDE))
    plain = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.struct((i * STRIDE).alias("start"), F.least(i * STRIDE + SIZE, n).alias("end")))
    return F.when(n == 0, F.array().cast(WINDOWS)).otherwise(plain)


def windows(text: Column) -> Column:
    """Array of window spans. Only texts that are not ASCII go through Python."""
    return F.when(is_ascii(text), plain_windows(text)).otherwise(F.pandas_udf(_other_windows, WINDOWS)(F.when(~is_ascii(text), text)))


def _other_slices(s: pd.Series) -> pd.Series:
    def cut(t: str) -> list[dict]:
        data = t.encode("utf-8", "surrogatepass")
        return [w | {"text": unicodedata.normalize("NFKC", data[w["start"] : w["end"]].decode("utf-8", "surrogatepass"))} for w in windows_of(data)]

    return s.map(lambda t: None if t is None else cut(t))


def slices(text: Column) -> Column:
    """Windows with their NFKC text, which is null for ASCII, as that can be cut without Python."""
    plain = F.transform(plain_windows(text), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit(None).cast("string").alias("text")))
    return F.when(is_ascii(text), plain).otherwise(F.pandas_udf(_other_slices, SLICES)(F.when(~is_ascii(text), text)))


def chunk(strings: DataFrame) -> DataFrame:
    """Windows of extracted strings: path, string_seq, base, text, provenance -> path, chunk_seq, span, text, provenance.

    `base` moves the spans of strings whose place in the file is known. Slices are cut first and normalised then.
    """
    cut = strings.select("path", "string_seq", "base", "text", "provenance", F.posexplode(slices(F.col("text"))).alias("w", "at"))
    part = F.substring(F.col("text").cast("binary"), (F.col("at.start") + 1).cast("int"), (F.col("at.end") - F.col("at.start")).cast("int")).cast("string")
    return cut.select(
        "path",
        # strings of a file have at most 2^12 windows each below 2^20 bytes, so this keeps their order
        (F.col("string_seq").cast("bigint") * 1_000_000 + F.col("w")).alias("chunk_seq"),
        F.struct((F.col("base") + F.col("at.start")).alias("start"), (F.col("base") + F.col("at.end")).alias("end")).alias("span"),
        F.coalesce("at.text", part).alias("text"),
        "provenance",
    )


def prose(table: DataFrame, path: Column, text: Column) -> DataFrame:
    """A text column as extracted strings of prose."""
    return table.select(path.cast("string").alias("path"), F.lit(0).alias("string_seq"), F.lit(0).cast("bigint").alias("base"), text.alias("text"), F.lit("Prose").alias("provenance")).where("text is not null")
