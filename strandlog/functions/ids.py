"""Deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the URL namespace of RFC 9562


def raw_key(*columns: str) -> Column:
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based UUID (version 5) of a text: SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def blob_sha1(text: Column) -> Column:
    """The id that git gives a file with this text."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(text).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")))
