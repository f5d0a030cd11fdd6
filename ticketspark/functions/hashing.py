"""Deterministic pseudo-random order and buckets, identical in Spark and in SQL engines.

``rand(seed)``, ``sample`` and ``randomSplit`` depend on partitioning; everything that
needs a "random" order here uses an md5 of ``seed|id`` instead, with the id as the
tie-break, so results do not change with the number or layout of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def order_key(id_col: Column | str, seed: int | str = DEFAULT_SEED) -> Column:
    """Hex md5 of ``'<seed>|<id>'``; sort by (this, id) for a seeded shuffle."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))


def hex_prefix(hex_col: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex digits (0 .. 16**digits - 1)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def bucket(tag: str, id_col: Column | str) -> Column:
    """Bucket 0..15 from the first hex digit of md5('<tag>|<id>')."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return hex_prefix(F.md5(F.concat(F.lit(f"{tag}|"), c.cast("string"))), 1)


def fingerprint_term(cols: list[Column], digits: int = 15) -> Column:
    """First ``digits`` hex digits of an md5 over all ``cols`` as bigint; summed per table
    as decimal it is an order-insensitive content fingerprint. The first column is taken
    as it is; the others by their md5 (a null as a dash), so that no separator can be
    mistaken."""
    first, *rest = cols
    return hex_prefix(F.md5(F.concat_ws("|", first.cast("string"), *[F.coalesce(F.md5(c), F.lit("-")) for c in rest])), digits)
