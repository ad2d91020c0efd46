"""Deterministic, engine-independent hashing.

Every seeded permutation or draw orders by ``md5(seed:key...)`` so that the
result does not depend on partitioning and has an SQL equal in other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_key(seed, *parts) -> Column:
    """md5 of 'seed:part1:part2...' (parts cast to string)."""
    items = [F.lit(str(seed))] + [_c(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *items))


def hex8(col) -> Column:
    """First 8 hex digits of a hex string as a non-negative BIGINT."""
    return F.conv(F.substring(_c(col), 1, 8), 16, 10).cast("bigint")


def md5_int(seed, *parts) -> Column:
    return hex8(md5_key(seed, *parts))
