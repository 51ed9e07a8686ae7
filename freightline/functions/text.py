"""Hashing, protection and formatting helpers (FN11-FN17)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_key(cols: Sequence[str]) -> Column:
    """Deterministic 64-bit key of a request's parameters, column order fixed by
    name so identical requests collide (FN11)."""
    return F.xxhash64(*[F.col(c) for c in sorted(cols)])


# JSON options of hashed records: nulls kept, timestamps to the microsecond.
RECORD_JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                       "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def record_json(cols: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), RECORD_JSON_OPTIONS)


def record_hash(cols: Sequence[str]) -> Column:
    """SHA-256 of the record as JSON with sorted keys, nulls kept (FN12)."""
    return F.sha2(record_json(cols), 256)


def protect(col, key: Column) -> Column:
    """AES-GCM encryption (random IV) to base64 text (FN13)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.base64(F.aes_encrypt(c.cast("binary"), key, F.lit("GCM")))


def recover(col, key: Column) -> Column:
    """Inverse of :func:`protect` (FN13)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


def from_unix_seconds(col) -> Column:
    """Unix seconds -> timestamp (UTC session zone) (FN14)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_seconds(c)
