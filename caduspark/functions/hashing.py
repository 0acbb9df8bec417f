"""Keyed hashes as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_pads(key: bytes) -> tuple[str, str]:
    """Hex of the inner and outer pad of HMAC-SHA256."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text.  The padded key shows in plans; set spark.sql.redaction.string.regex for logs."""
    inner, outer = hmac_pads(key)
    return hmac_by_pads(message, F.lit(inner), F.lit(outer))


def hmac_by_pads(message: Column, inner: Column, outer: Column) -> Column:
    """Hex HMAC-SHA256 of a text under the hmac_pads() of the row's own key; null where the row has none."""
    first = F.sha2(F.concat(F.unhex(inner), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(outer), F.unhex(first)), 256)


def payload_hash(payload: Column) -> Column:
    """SHA-256 of a text payload, for input_hash and output_hash."""
    return F.sha2(payload, 256)
