"""Content keys and keyed digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofgrid.functions.text import fold, squash


def text_key(text: Column) -> Column:
    """SHA-256 of the folded, squashed text: equal for copies that differ in case, accents or spacing."""
    return F.sha2(F.trim(F.regexp_replace(fold(text), "\\s+", " ")), 256)


def canonical_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as one JSON object with sorted keys (give the fields in key order)."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def hmac_sha256(key_hex: str, message: Column) -> Column:
    """HMAC-SHA-256 from two nested digests; the key is given as hex."""
    key = bytes.fromhex(key_hex).ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)
