"""What may be shown of a found value, and keyed hashes of values that may not be stored."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Categories of which nothing is shown but what they are.
LABELS = {
    "sensitive_term": "[sensitive term]",
    "internal_term": "[internal term]",
    "litigation_party": "[party name]",
    "address": "[address]",
    "email": "[email]",
    "protected_name": "[protected name]",
}


def mask_value(category: Column, value: Column) -> Column:
    """Masked form of a value: a label, or the ends of a long value with stars between."""
    v = F.trim(value)
    n = F.length(v)
    masked = F.when(n <= 8, F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), F.greatest(n - 1, F.lit(0))))).otherwise(
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), F.least(n - 6, F.lit(20))), F.right(v, F.lit(2)))
    )
    out = F.when(category == "local_path", F.concat(F.lit("[local path, "), n.cast("string"), F.lit(" characters]")))
    for name, label in LABELS.items():
        out = out.when(category == name, label)
    return out.otherwise(masked)


class Hmac20:
    """First 20 hex digits of HMAC-SHA256 of strings under one key of at most 64 bytes."""

    def __init__(self, key: bytes):
        if not key or len(key) > 64:
            raise ValueError("a key of 1 to 64 bytes is needed")
        padded = key.ljust(64, b"\0")
        self.inner, self.outer = (hashlib.sha256(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))

    def digest(self, message: str) -> bytes:
        inner, outer = self.inner.copy(), self.outer.copy()
        inner.update(message.encode())
        outer.update(inner.digest())
        return outer.digest()[:10]

    def __call__(self, message: str) -> str:
        return self.digest(message).hex()


_HELD: dict[tuple[str, bytes], Broadcast] = {}


def held(spark: SparkSession, key: bytes) -> Broadcast:
    """The key as a broadcast, one for each application. Plans, their explanations and event logs name its number only."""
    Hmac20(key)  # a bad key fails here
    name = (spark.sparkContext.applicationId, key)
    if name not in _HELD:
        _HELD[name] = spark.sparkContext.broadcast(key)
    return _HELD[name]


def hmac_sha256_20(message: Column, key: bytes) -> Column:
    """First 20 hex digits of HMAC-SHA256 of a string. The key isn't in the plan; one pass through Arrow. Null stays null."""
    secret = held(SparkSession.active(), key)

    @F.arrow_udf("string")
    def hmac_20(messages: pa.Array) -> pa.Array:
        of = Hmac20(secret.value)
        return pa.array([None if m is None else of(m) for m in messages.to_pylist()], pa.string())

    return hmac_20(message)
