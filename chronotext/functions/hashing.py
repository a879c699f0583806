"""Reproducible randomness: values depend on row keys, a seed and a salt, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: int, salt: str, *keys: str | Column) -> Column:
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)), F.lit(salt)))


def uniform(seed: int, salt: str, *keys: str | Column) -> Column:
    """Uniform double in [0, 1) from 32 bits of the digest."""
    head = F.conv(F.substring(_digest(seed, salt, *keys), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def hash60(seed: int, salt: str, *keys: str | Column) -> Column:
    """Non-negative 60-bit integer, used as a random sort key."""
    return F.conv(F.substring(_digest(seed, salt, *keys), 1, 15), 16, 10).cast("bigint")


def pick(u: Column, n: Column | int) -> Column:
    """Index in 0..n-1 from a uniform draw."""
    return F.floor(u * (F.lit(n) if isinstance(n, int) else n)).cast("int")
