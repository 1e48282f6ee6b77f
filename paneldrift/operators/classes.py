"""Change classes of units and their totals per area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import filled, net_change, ratio
from .pairs import UNIT
from .scale import durable_table, join_on, with_totals

# Class labels and their fixed order.
LOST_UNIT, NEW_UNIT = "Lost DA", "New DA"
LOST_DENSITY, NEW_DENSITY = "Lost Density", "New Density"
NET_DENSITY, NET_UNITS, NET_TOTAL = "Net Density", "Net DAs", "Net Total"
SIGN_ORDER = ["Loss", "No Change", "Gain"]


def within_unit_change(pv: DataFrame) -> DataFrame:
    """Pairs with both values: d and Loss (d < 0) or Gain (no change included)."""
    return (
        pv.where(F.col("m1").isNotNull() & F.col("m2").isNotNull())
        .withColumn("d", F.col("m2") - F.col("m1"))
        .withColumn("tt", F.when(F.col("d") < 0, "Loss").otherwise("Gain"))
    )


def gain_loss(pv: DataFrame) -> DataFrame:
    """Gain, loss and net totals per period in one pass: group, y2, tt, d."""
    keys = [F.col("group"), F.col("y2"), F.col("tt")]
    return (
        within_unit_change(pv)
        .groupingSets([keys, keys[:2]], *keys)
        .agg(F.sum("d").alias("d"), F.grouping("tt").alias("_net"))
        .select(
            "group", "y2", F.when(F.col("_net") == 1, "Net").otherwise(F.col("tt")).alias("tt"), "d"
        )
    )


def _sign_label() -> Column:
    s = F.signum(F.col("d").cast("double"))
    return F.when(s < 0, SIGN_ORDER[0]).when(s == 0, SIGN_ORDER[1]).otherwise(SIGN_ORDER[2])


def sign_counts(pv: DataFrame) -> DataFrame:
    """Number of units by direction of change per period."""
    return (
        within_unit_change(pv)
        .groupBy("group", "y2", _sign_label().alias("sign"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sign_share(pv: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """Share of a unit's periods with each direction of change, with its coordinates."""
    counts = (
        within_unit_change(pv)
        .groupBy(*UNIT, _sign_label().alias("sign"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # three rows per unit and group at most
    shares = counts.withColumn("tot", F.sum("n").over(Window.partitionBy("unit"))).withColumn(
        "pct", ratio("n", "tot")
    )
    if coordinates is None:
        return shares
    return join_on(shares, coordinates, ["unit"], "left", null_safe=False)


def change_class(pv: DataFrame) -> DataFrame:
    """Four-way class of every pair row and its change; NULL class when both values are missing."""
    m1, m2 = F.col("m1"), F.col("m2")
    label = (
        F.when(m1.isNotNull() & m2.isNull(), LOST_UNIT)
        .when(m1.isNull() & m2.isNotNull(), NEW_UNIT)
        .when(m1 > m2, LOST_DENSITY)
        .when(m1 <= m2, NEW_DENSITY)
    )
    return pv.withColumns({"tt": label, "d_m": net_change(m1, m2)})


def lump_rare(
    df: DataFrame,
    category: str,
    min_count: int,
    scope: Sequence[str],
    other: Column,
    name: str,
) -> DataFrame:
    """Replace categories with fewer than min_count rows in their scope by ``other``; NULL stays NULL.

    Row counts come from an aggregation looked up again, so a category holding most of a
    scope does not end in one task. The rows are read twice, so they are written once.
    """
    keys = [*scope, category]
    df = durable_table(df)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = join_on(df, counts, keys, "left", null_safe=True)
    lumped = (
        F.when(F.col(category).isNull(), F.lit(None))
        .when(F.col("_n") >= min_count, F.col(category))
        .otherwise(other)
    )
    return counted.withColumn(name, lumped).drop("_n")


def change_class_area(
    pv: DataFrame,
    dictionary: DataFrame,
    area: str = "area",
    lump_min: int = 80,
    scope: Sequence[str] = ("group", "y1"),
) -> DataFrame:
    """Change classes with the unit's dictionary row and its area, rare areas lumped per scope.

    Keys stay unique (one dictionary row per unit), so no distinct is needed. Build ``pv``
    with ``by_unit_only=True`` to join without shuffling it again.
    """
    joined = join_on(change_class(pv), dictionary, ["unit"], "left", null_safe=False)
    other = F.concat(F.lit("Other ("), F.col("group"), F.lit(")"))
    return lump_rare(joined, area, lump_min, scope, other, f"{area}_lump")


def class_sum(*labels: str) -> Column:
    """Total change of the rows in some classes, zero when there are none."""
    return F.sum(F.when(F.col("tt").isin(*labels), F.col("d_m")).otherwise(F.lit(0)))


def net_by(df: DataFrame, keys: Sequence[str], with_total: bool = False) -> DataFrame:
    """Net density and net unit change per key, zero where a class has no rows: keys, tt, d_m."""
    measures = {
        NET_DENSITY: class_sum(NEW_DENSITY, LOST_DENSITY),
        NET_UNITS: class_sum(NEW_UNIT, LOST_UNIT),
    }
    if with_total:
        measures[NET_TOTAL] = F.sum("d_m")
    wide = df.groupBy(*keys).agg(*[c.alias(k) for k, c in measures.items()])
    return wide.unpivot(list(keys), [f"`{k}`" for k in measures], "tt", "d_m")


def share_of_total(df: DataFrame, value: str, within: Sequence[str]) -> DataFrame:
    """tot = sum of value within the keys, pct = value / tot."""
    return with_totals(df, within, {"tot": F.sum(value)}).withColumn("pct", ratio(value, "tot"))


def zero_filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: filled(c) for c in columns})


