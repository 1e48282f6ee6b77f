"""Column expressions with explicit rules for missing values and zero divisors.

All of them are plain Spark expressions: they stay inside whole-stage codegen
and can be used in ``select``, ``agg`` or ``withColumns`` alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

WHOLE = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: ColumnLike) -> Column:
    """Sum that is NULL as soon as one value of the group is NULL."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_avg(c: ColumnLike) -> Column:
    """Mean that is NULL as soon as one value of the group is NULL."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def filled(c: ColumnLike, default: object = 0) -> Column:
    return F.coalesce(col(c), F.lit(default))


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den as double, NULL when the divisor is zero or missing."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def growth(m1: ColumnLike, m2: ColumnLike) -> Column:
    """m2 / m1 - 1, NULL for a zero base."""
    return ratio(m2, m1) - 1


def relative_change(m1: ColumnLike, m2: ColumnLike) -> Column:
    """m2 / m1 - 1 where growth from zero is infinite and 0/0 is missing."""
    m1, m2 = col(m1), col(m2)
    inf = F.lit(float("inf"))
    return (
        F.when((m1 == 0) & (m2 > 0), inf)
        .when((m1 == 0) & (m2 < 0), -inf)
        .otherwise(growth(m1, m2))
    )


def as_index(value: ColumnLike, base: ColumnLike) -> Column:
    """value as a percentage of base."""
    return ratio(value, base) * 100


def net_change(m1: ColumnLike, m2: ColumnLike) -> Column:
    """m2 - m1 with a missing side counted as zero."""
    return filled(m2) - filled(m1)


def safe_int(c: ColumnLike) -> Column:
    """Text to whole number, exact up to 64 bits; a decimal or exponent loses its fraction; NULL for
    anything that is no number."""
    c = col(c).cast("string")
    return F.when(F.trim(c).rlike(WHOLE), c.try_cast("bigint")).when(
        F.trim(c).rlike(DECIMAL), c.try_cast("double").try_cast("bigint")
    )


def weighted_avg(x: ColumnLike, w: ColumnLike) -> Column:
    """Weighted mean over rows with a value; one missing weight among them makes it NULL."""
    x, w = col(x), col(w)
    kept_w = F.when(x.isNotNull(), w)
    total_w = F.when(F.count(kept_w) == F.count(x), F.sum(kept_w))
    return ratio(F.sum(x * w), total_w)
