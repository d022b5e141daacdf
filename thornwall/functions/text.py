"""Scalar functions on texts, as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NATURAL_LANGUAGE, SEVERITIES, WEIGHTS
from .stats import fnv1a64_all

MARKS = r"[̀-ͯ]"
#: Letters that look like a Latin letter, and that letter.
CONFUSABLES = {
    # Cyrillic
    "а": "a", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S",
    # Greek
    "ο": "o", "ι": "i", "κ": "k", "ρ": "p", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
#: Look-alikes that are counted but not mapped.
ONLY_COUNTED = "внтѡ"
CYRILLIC = "".join(c for c in CONFUSABLES if "Ѐ" <= c <= "ԯ") + ONLY_COUNTED
GREEK = "".join(c for c in CONFUSABLES if "Ͱ" <= c <= "Ͽ")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Plain ASCII is a fixed point, so only other texts go through Python."""
    return F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(~is_ascii(text), text)), text)


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def remap_confusables(text: Column) -> Column:
    return F.translate(text, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def _escapes() -> list[tuple[str, str]]:
    plain = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    controls = [chr(c) for c in (*range(0x20), *range(0x7F, 0xA0))]
    return [(c, plain.get(c, f"\\u{{{ord(c):04x}}}")) for c in controls]


def escape_controls(text: Column) -> Column:
    """Line feeds, returns and tabs as two characters, other control characters as \\u{....}."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    table = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(e).alias("e")) for c, e in _escapes()))
    other = F.aggregate(table, text, lambda acc, x: F.replace(acc, x["c"], x["e"]))
    return F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"), other).otherwise(plain)


def evidence(text: Column, most: int) -> Column:
    """The first `most` characters with control characters escaped, and an ellipsis if there were more."""
    cut = escape_controls(F.left(text, F.lit(most)))
    return F.when(F.char_length(text) > most, F.concat(cut, F.lit("…"))).otherwise(cut)


def severity_label(severity: Column) -> Column:
    return F.when(severity.isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITIES)), severity + 1))


def severity_weight(severity: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEIGHTS)), severity + 1)


def parse_severity(name: Column) -> Column:
    """Ordinal of a severity name, null if unknown."""
    low = F.lower(F.trim(name))
    low = F.when(low == "med", "medium").when(low == "crit", "critical").otherwise(low)
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), low)
    return F.when(at > 0, (at - 1).cast("int"))


def is_natural_language(provenance: Column) -> Column:
    return provenance.isin(*NATURAL_LANGUAGE)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def located(text: Column, pattern: Column | str) -> Column:
    """Matches of a pattern in order, as structs of byte start `s`, byte end `e` and text `m`."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern)

    nothing = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), nothing.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.octet_length(x["gap"])
        e = s + F.octet_length(x["m"])
        one = F.struct(s.cast("bigint").alias("s"), e.cast("bigint").alias("e"), x["m"].alias("m"))
        return F.struct(e.cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _fnv1a64_hex(s: pd.Series) -> pd.Series:
    there = s.notna().to_numpy()
    out = pd.Series([None] * len(s), dtype=object)
    out[there] = [f"{h:016x}" for h in fnv1a64_all([t.encode("utf-8", "surrogatepass") for t in s[there]]).tolist()]
    return out


def fnv1a64_hex(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes in hex, of a batch of texts at a time; the JVM has no cheap way to go over bytes."""
    return F.pandas_udf(_fnv1a64_hex, "string")(text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if their lengths differ or one is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def mean_pool(tokens: Column) -> Column:
    """Average of the vectors of an array of arrays."""
    sums = F.aggregate(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.transform(F.element_at(tokens, 1), lambda x: x.cast("double")), lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(sums, lambda x: x / F.size(tokens))


def normalise(text: Column) -> Column:
    """Letters and digits in lower case; every run of others becomes one space, none at the start."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}]+", " ")), "^ ", "")


def looks_like_url(source: Column) -> Column:
    return source.rlike(r"^(https?://|git@|ssh://|git://)")


def display_name(source: Column) -> Column:
    """The last part of a path or address, without .git."""
    trimmed = F.regexp_replace(F.regexp_replace(source, r"/+$", ""), r"\\+$", "")
    last = F.regexp_replace(F.regexp_extract(trimmed, r"([^/\\:]+)[/\\:]*$", 1), r"(\.git)+$", "")
    return F.when(last == "", source).otherwise(last)


def rfc3339(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
