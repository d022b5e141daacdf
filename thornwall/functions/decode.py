"""Strict decoders: null unless the whole input is well formed and its bytes are UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical base64: right padding, and no bits set beyond the last byte.
BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/][AQgw]==|[A-Za-z0-9+/]{2}[AEIMQUYcgkosw048]=)?$"


def _utf8(data: Column) -> Column:
    return F.try_validate_utf8(data.cast("string"))


def base64_text(s: Column) -> Column:
    """Standard alphabet as it stands; failing that, the URL-safe one without its padding."""
    other = F.translate(F.regexp_replace(s, "=+$", ""), "-_", "+/")
    return F.when(s.rlike(BASE64), _utf8(F.unbase64(F.when(s.rlike(BASE64), s)))).when(other.rlike(BASE64), _utf8(F.unbase64(F.when(other.rlike(BASE64), other))))


def hex_text(s: Column) -> Column:
    """Pairs of hex digits; an odd last digit is left out."""
    return F.when(s.rlike("^[0-9A-Fa-f]*$"), _utf8(F.unhex(F.left(s, F.length(s) - F.length(s) % 2))))


def url_text(s: Column) -> Column:
    """Runs of %xx."""
    return F.when(s.rlike("^(%[0-9A-Fa-f]{2})*$"), _utf8(F.unhex(F.replace(s, F.lit("%"), F.lit("")))))
