"""Long term/value profiles to one row per unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import safe_int
from .scale import join_on


def profile_wide(
    long: DataFrame,
    term_map: Mapping[str, str],
    units: DataFrame | None = None,
    sums: Mapping[str, Sequence[str]] | None = None,
    ids: Sequence[str] = ("unit",),
    term: str = "term",
    value: str = "value",
) -> DataFrame:
    """One row per unit with the mapped terms as whole-number columns.

    Only the wanted terms and units are kept, the pivot has a fixed column list, text that is
    no number becomes NULL, and the parts of a sum are replaced by their total (NULL when
    one part is).
    """
    wanted = long.where(F.col(term).isin(list(term_map)))
    if units is not None:
        wanted = join_on(
            wanted, units.select("unit").distinct(), ["unit"], "left_semi", null_safe=False
        )
    wide = wanted.groupBy(*ids).agg(
        *[
            safe_int(F.max(F.when(F.col(term) == label, F.col(value)))).alias(name)
            for label, name in term_map.items()
        ]
    )
    for total, parts in (sums or {}).items():
        value_sum = F.col(parts[0])
        for part in parts[1:]:
            value_sum = value_sum + F.col(part)
        wide = wide.withColumn(total, value_sum).drop(*parts)
    return wide


def row_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace columns by their share of the row total."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return df.withColumns(
        {c: F.try_divide(F.col(c).cast("double"), total.cast("double")) for c in columns}
    )
