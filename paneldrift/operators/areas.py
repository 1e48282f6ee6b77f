"""Area roll-ups, rankings and bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import CHANGE_BREAKS, CHANGE_LABELS, cut
from ..functions.text import recode
from ..functions.values import filled, net_change, ratio, strict_sum
from .classes import (
    LOST_DENSITY,
    LOST_UNIT,
    NET_DENSITY,
    NET_UNITS,
    NEW_DENSITY,
    NEW_UNIT,
    class_sum,
)
from .pairs import UNIT
from .scale import durable_table, join_on


def rank_areas(pv: DataFrame, dictionary: DataFrame, area: str = "area") -> DataFrame:
    """Total change per area, largest first.

    Changes are summed per unit before the dictionary join, which then meets one row per unit.
    """
    per_unit = pv.groupBy(*UNIT).agg(F.sum(net_change("m1", "m2")).alias("d_m"))
    totals = (
        join_on(per_unit, dictionary, ["unit"], "left", null_safe=False)
        .groupBy(area)
        .agg(F.sum("d_m").alias("tot"))
    )
    return largest_first(totals, "tot", area)


def largest_first(df: DataFrame, value: str, name: str) -> DataFrame:
    """Sorted by descending value, missing values last, ties by name."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(name).asc_nulls_last())


def area_cube(
    classified: DataFrame, dictionary: DataFrame, area: str = "area", parent: str | None = None
) -> DataFrame:
    """The area analysis in one table, written: change and both levels by (area, y1, y2, tt).

    Pairs meet the dictionary once. Every dictionary unit is kept: an area whose units have no pairs
    has a row without periods. Sums over classes, periods or areas of this table give changes,
    roll-ups, levels and densities; ``parent`` adds the first parent name of the area's units.
    """
    rows = classified.select("unit", "y1", "y2", "tt", "m1", "m2", "d_m")
    columns = ["unit", area] if parent is None else ["unit", area, parent]
    first = [] if parent is None else [F.min(parent).alias(parent)]
    return durable_table(
        join_on(rows, dictionary.select(*columns), ["unit"], "right", null_safe=False)
        .groupBy(area, "y1", "y2", "tt")
        .agg(
            F.sum("d_m").alias("d_m"),
            F.sum(filled("m1")).alias("m1"),
            F.sum(filled("m2")).alias("m2"),
            F.count("y1").alias("n"),
            *first,
        )
    )


def cube_changes(cube: DataFrame, area: str = "area") -> DataFrame:
    """Net change by (period, class, area) of an area cube."""
    net = {
        NET_DENSITY: class_sum(NEW_DENSITY, LOST_DENSITY),
        NET_UNITS: class_sum(NEW_UNIT, LOST_UNIT),
    }
    rows = F.array(
        *[F.struct(F.lit(label).alias("tt"), total.alias("d_m")) for label, total in net.items()]
    )
    # dictionary units without changes have no period: one NULL row per area
    none = F.array(F.struct(F.lit(None).alias("tt"), F.lit(None).cast("bigint").alias("d_m")))
    return (
        cube.groupBy("y1", "y2", area)
        .agg(rows.alias("_net"))
        .withColumn("_net", F.when(F.col("y1").isNull(), none).otherwise(F.col("_net")))
        .select("y1", "y2", area, F.inline("_net"))
    )


def cube_levels(cube: DataFrame, area: str = "area") -> DataFrame:
    """Level of both periods per (area, pair) of an area cube."""
    return cube.groupBy(area, "y1", "y2").agg(F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))


def cube_rollup(
    cube: DataFrame,
    area: str = "area",
    parent: str = "parent",
    breaks: Sequence[float] = CHANGE_BREAKS,
    labels: Sequence[str] = CHANGE_LABELS,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Area totals over periods and classes of a cube, with the first parent name and the change bin.

    As in ``rollup_area``, an area with units that have no pairs has a missing total.
    """
    change = F.sum(F.when(F.col("tt").isin(NEW_DENSITY, LOST_DENSITY, NEW_UNIT, LOST_UNIT), F.col("d_m")))
    complete = F.count("y1") == F.count(F.lit(1))
    joined = cube.groupBy(area).agg(
        F.when(complete, F.coalesce(change, F.lit(0))).alias("d_m"), F.min(parent).alias(parent)
    )
    if rename:
        joined = joined.withColumn(parent, recode(parent, rename))
    return bin_change(joined, "d_m", breaks, labels)


def area_changes(
    classified: DataFrame, dictionary: DataFrame, area: str = "area"
) -> DataFrame:
    """Net change by (period, class, area); dictionary units without changes stay as NULL rows."""
    return cube_changes(area_cube(classified, dictionary, area), area)


def area_levels(pv: DataFrame, dictionary: DataFrame, area: str = "area") -> DataFrame:
    """Level of both periods per (area, pair), missing = 0, every dictionary unit kept."""
    return (
        join_on(pv.select("unit", "y1", "y2", "m1", "m2"), dictionary, ["unit"], "right", null_safe=False)
        .groupBy(area, "y1", "y2")
        .agg(F.sum(filled("m1")).alias("m1"), F.sum(filled("m2")).alias("m2"))
    )


def bin_change(
    df: DataFrame,
    value: str = "d_m",
    breaks: Sequence[float] = CHANGE_BREAKS,
    labels: Sequence[str] = CHANGE_LABELS,
    name: str = "gg",
) -> DataFrame:
    return df.withColumn(name, cut(value, breaks, labels))


def rollup_area(
    changes: DataFrame,
    dictionary: DataFrame,
    area: str = "area",
    parent: str = "parent",
    breaks: Sequence[float] = CHANGE_BREAKS,
    labels: Sequence[str] = CHANGE_LABELS,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """Area totals over periods and classes with the area's first parent name and its change bin.

    A missing value makes its area's total missing, which is why rolling up by (class, area)
    first would give the same totals.
    """
    totals = changes.groupBy(area).agg(strict_sum("d_m").alias("d_m"))
    parents = dictionary.groupBy(area).agg(F.min(parent).alias(parent))
    joined = join_on(totals, parents, [area], "left", null_safe=True)
    if rename:
        joined = joined.withColumn(parent, recode(parent, rename))
    return bin_change(joined, "d_m", breaks, labels)


def enrichment(df: DataFrame, by: str, bin_col: str = "gg", negative: str = CHANGE_LABELS[0]) -> DataFrame:
    """Share of shrinking areas per parent; rows without a bin count on neither side."""
    neg = F.count(F.when(F.col(bin_col) == negative, F.lit(1)))
    pos = F.count(F.when(F.col(bin_col) != negative, F.lit(1)))
    return (
        df.groupBy(by)
        .agg(neg.alias("neg"), pos.alias("pos"))
        .withColumn("pct", ratio("neg", F.col("neg") + F.col("pos")))
    )


def density(df: DataFrame, value: str, area: str, name: str = "density") -> DataFrame:
    """value / (area * 1000), NULL for an empty area."""
    return df.withColumn(name, ratio(value, F.col(area) * 1000))
