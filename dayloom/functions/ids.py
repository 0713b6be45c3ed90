"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: the RFC 4122 name space for URLs
UNIT_SEPARATOR = "\x1f"


def sha_key(*parts: Column, sep: str = ":") -> Column:
    """SHA-256 hex of the parts joined by ``sep``; a null part counts as empty."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """RFC 4122 version 5 UUID of a name, with built-in functions only."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.translate(h.substr(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"), variant, h.substr(18, 3), F.lit("-"), h.substr(21, 12))


def iso_micros(ts: Column) -> Column:
    """A UTC instant as Python's isoformat writes it: microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, fraction, F.lit("+00:00"))
