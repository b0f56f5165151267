"""Digests: canonical hashes, HMAC-SHA256 and name-based UUIDs from built-in functions."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*columns: Column) -> Column:
    """sha256 of the columns as one JSON object."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def hmac_sha256(key: bytes, text: Column) -> Column:
    """Hex HMAC-SHA256; the two padded keys are literals, so no Python runs on rows."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The name-based UUID of version 5, from sha1 of the namespace and the name."""
    h = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
