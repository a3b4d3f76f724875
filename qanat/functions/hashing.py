"""Hashes that other systems can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_messages(messages: Column, normalize=lambda c: c) -> Column:
    """JSON of the messages with sorted keys, no spaces and no escapes of other scripts."""
    return F.to_json(F.transform(messages, lambda m: F.struct(normalize(m["content"]).alias("content"), m["role"].alias("role"))), {"ignoreNullFields": "false"})


def conversation_hash(messages: Column, normalize=lambda c: c) -> Column:
    """The three variants of the contracts differ in ``normalize`` only."""
    return F.sha2(canonical_messages(messages, normalize), 256)


def stable_number(seed: str, key: Column) -> Column:
    """The first eight bytes of a hash as an unsigned number; a signed one would overflow."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_choice(seed: str, key: Column, n: int) -> Column:
    return (stable_number(seed, key) % F.lit(n)).cast("int")


def digest_choice(key: Column, byte: int, n: int) -> Column:
    """Byte ``byte`` of a hash of the key, modulo n."""
    return (F.conv(F.substring(F.sha2(key.cast("string"), 256), 2 * byte + 1, 2), 16, 10).cast("int") % F.lit(n)).cast("int")


def stable_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(key.cast("string"), 256), 1, 10))
