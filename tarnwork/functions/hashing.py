"""Repeatable pseudo-random values from row keys.

A value depends on (seed, salt, key) only, so a retried task, another
partitioning or another run gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 1 << 32


def key_hash(key: Column, salt: str, seed: int = 42) -> Column:
    """Whole number in [0, 2**32) from a key."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string"))
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("long")


def key_fraction(key: Column, salt: str, seed: int = 42) -> Column:
    """Number in [0, 1) from a key."""
    return key_hash(key, salt, seed) / F.lit(float(SPAN))


def pick(key: Column, salt: str, choices: list[str], seed: int = 42) -> Column:
    """One of a few fixed choices by key."""
    index = key_hash(key, salt, seed) % len(choices)
    return F.get(F.array(*[F.lit(c) for c in choices]), index.cast("int"))
