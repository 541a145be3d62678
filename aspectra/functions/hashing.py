"""Reproducible randomness.

Rows are ordered by ``md5(seed|salt|id)``: the value depends only on the row,
never on partitioning or task order, and the same digest is computed by any
SQL engine, so draws can be checked against an oracle.  Draws in [0, n) use
the first 15 hex digits of such a digest as an unsigned 60-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra.dicts import SEED


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def order_key(salt: str, *ids, seed: int = SEED) -> Column:
    """Hex md5 of ``seed|salt|id...``; sorting by it is a seeded shuffle."""
    parts = [F.lit(str(seed)), F.lit(salt)] + [_c(i).cast("string") for i in ids]
    return F.md5(F.concat_ws("|", *parts))


def hex_prefix_int(hexstr: Column, digits: int = 15) -> Column:
    """First ``digits`` hex digits of a digest as a non-negative bigint."""
    return F.conv(F.substring(hexstr, 1, digits), 16, 10).cast("bigint")


def uniform(salt: str, *ids, seed: int = SEED) -> Column:
    """Deterministic uniform draw in [0, 1)."""
    return hex_prefix_int(order_key(salt, *ids, seed=seed)) / F.lit(float(1 << 60))


def draw_index(n, salt: str, *ids, seed: int = SEED) -> Column:
    """Deterministic draw in [0, n)."""
    return F.pmod(hex_prefix_int(order_key(salt, *ids, seed=seed)), _c(n) if not isinstance(n, int) else F.lit(n))


def bucket_of(key_hex: Column, digits: int) -> Column:
    """Ordered bucket of an md5 key: its first ``digits`` hex digits as int.
    Sorting by (bucket, key) equals sorting by key."""
    return F.conv(F.substring(key_hex, 1, digits), 16, 10).cast("int")
