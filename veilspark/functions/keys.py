"""HMAC key material that stays out of plans, UIs and event logs."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

SECRET_VARIABLE = "HMAC_SECRET"
KEY_VERSION = "V1"  # fixed value: part of every token
_BLOCK = 64  # SHA-256 block size in bytes


class TokenKeys:
    """The two padded HMAC keys (RFC 2104) as scalar subqueries.

    A literal would show up in ``explain`` and the event log. A one-row local
    table read through a scalar subquery shows only its column name, needs no
    join and keeps the tokenising projection inside one codegen stage.
    """

    def __init__(self, spark: SparkSession, secret: bytes | str):
        raw = secret.encode("utf-8") if isinstance(secret, str) else secret
        if not raw:
            raise RuntimeError("the token secret is empty")
        if len(raw) > _BLOCK:
            raw = hashlib.sha256(raw).digest()
        padded = raw.ljust(_BLOCK, b"\0")
        row = pa.table(
            {
                "ipad": pa.array([bytes(b ^ 0x36 for b in padded)], pa.binary()),
                "opad": pa.array([bytes(b ^ 0x5C for b in padded)], pa.binary()),
            }
        )
        pads = spark.createDataFrame(row)
        self._inner = pads.select("ipad").scalar()
        self._outer = pads.select("opad").scalar()

    @classmethod
    def from_env(cls, spark: SparkSession, variable: str = SECRET_VARIABLE) -> TokenKeys:
        secret = os.environ.get(variable, "")
        if not secret:
            raise RuntimeError(f"{variable} is not set")
        return cls(spark, secret)

    def hmac16(self, message: Column) -> Column:
        """First 16 hex digits, upper case, of HMAC-SHA256 over a string."""
        inner = F.unhex(F.sha2(F.concat(self._inner, message.cast("binary")), 256))
        digest = F.sha2(F.concat(self._outer, inner), 256)
        # hex() writes upper case; cheaper than upper(), which is locale-aware.
        return F.hex(F.unhex(F.substring(digest, 1, 16)))
