"""Repeatable random draws.

``rand()`` depends on partitioning and task retries. These draws depend only on
the seed and the row's own key, so a lost executor recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *cols) -> Column:
    """md5 text that orders rows at random but repeatably."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def draw_int(seed: int, *cols) -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(draw_key(seed, *cols), 1, 8), 16, 10).cast("bigint")


def draw_unit(seed: int, *cols) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(seed, *cols) / F.lit(4294967296.0)
