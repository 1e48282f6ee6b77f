"""Binning expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ColumnLike, col

# The three change bins of the area roll-up.
CHANGE_BREAKS = (-12000, 0, 5000, 60000)
CHANGE_LABELS = ("<0", "0-5K", ">5K")


def cut(c: ColumnLike, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins (lo, hi]; values outside all bins are NULL."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("need one label per bin")
    c = col(c)
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(breaks, breaks[1:], labels))):
        out = F.when((c > lo) & (c <= hi), F.lit(label)).otherwise(out)
    return out


def equal_width_bin(c: ColumnLike, low: Column, high: Column, bins: int) -> Column:
    """1-based bin over [low, high]; the maximum belongs to the last bin."""
    c = col(c)
    spread = F.width_bucket(c, low, high, F.lit(bins))
    return F.when(c.isNull(), F.lit(None)).when(high == low, F.lit(1).cast("bigint")).otherwise(
        F.least(spread, F.lit(bins).cast("bigint"))
    )
