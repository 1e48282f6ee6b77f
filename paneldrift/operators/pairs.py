"""Panels and pairs of periods.

A panel has one row per (group, unit, yr) and a nullable value. A unit is *missing* in a
period when it has no row there or a row with a NULL value. Everything below needs one
shuffle of the panel, on (group, unit), whatever the number of period pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import ratio, relative_change
from .scale import durable_table, join_on

PAIR_KEYS = ["group", "y1", "y2"]
UNIT = ["group", "unit"]


def as_panel(df: DataFrame, unit: str, group: str, time: str, value: str) -> DataFrame:
    """Rename any table of units over time to the standard panel columns."""
    return df.select(
        F.col(group).alias("group"),
        F.col(unit).alias("unit"),
        F.col(time).cast("int").alias("yr"),
        F.col(value).alias("value"),
    )


@dataclass(frozen=True)
class TimePairs:
    """Period pairs per group; ``years`` is the calendar of all pairs, as a scalar array."""

    df: DataFrame
    mode: str
    years: Column | None = None


def time_pairs(
    p: DataFrame, mode: str = "consecutive", years: Sequence[int] | None = None
) -> TimePairs:
    """(group, y1, y2) for all y1 < y2, or for each y1 the next period of that group.

    A pair belongs to a group when the group has a row in either period. ``years`` limits the
    periods before any pair is built.
    """
    if mode not in ("all", "consecutive"):
        raise ValueError("mode is 'all' or 'consecutive'")
    keys = p.select("group", "yr")
    if years is not None:
        keys = keys.where(F.col("yr").isin(list(years)))
    calendar = keys.distinct()
    all_years = calendar.agg(F.sort_array(F.collect_set("yr")).alias("ys")).scalar()
    own = calendar.groupBy("group").agg(F.collect_set("yr").alias("own")).withColumn("ys", all_years)

    def belongs(a: Column, b: Column) -> Column:
        return F.array_contains("own", a) | F.array_contains("own", b)

    def later(a: Column) -> Column:
        return F.filter("ys", lambda b: (b > a) & belongs(a, b))

    if mode == "all":
        nested = F.flatten(
            F.transform(
                "ys",
                lambda a: F.transform(later(a), lambda b: F.struct(a.alias("y1"), b.alias("y2"))),
            )
        )
    else:
        nested = F.transform(
            "ys", lambda a: F.struct(a.alias("y1"), F.array_min(later(a)).alias("y2"))
        )
    pairs = (
        own.select("group", F.explode(nested).alias("pair"))
        .select("group", "pair.y1", "pair.y2")
        .where(F.col("y2").isNotNull())
    )
    return TimePairs(pairs, mode, all_years)


def _roles(pairs: DataFrame) -> DataFrame:
    """One row per period of each pair: the period's rows are joined to it by equality."""
    role = F.array(
        F.struct(F.col("y1").alias("yr"), F.lit(True).alias("first")),
        F.struct(F.col("y2").alias("yr"), F.lit(False).alias("first")),
    )
    return pairs.select("*", F.inline(role))


def _with_roles(rows: DataFrame, pairs: TimePairs) -> DataFrame:
    """The rows once for each role of their period.

    A row shows that its group has its period, so all pairs of that period with others of the calendar
    belong to the group: they come from the calendar alone. Otherwise the roles, a few rows for
    each group and period, are written: their real size tells Spark whether to broadcast them.
    """
    if pairs.mode == "all":
        role = F.transform(
            F.filter("_years", lambda y: y != F.col("yr")),
            lambda y: F.struct(
                F.least(y, "yr").alias("y1"), F.greatest(y, "yr").alias("y2"), (y > F.col("yr")).alias("first")
            ),
        )
        return rows.withColumn("_years", pairs.years).select(*rows.columns, F.inline(role))
    return join_on(rows, durable_table(_roles(pairs.df)), ["group", "yr"], null_safe=True)


def unique_year(before: Column) -> Column:
    """The row's period; an error if the unit's row before has the same."""
    twice = F.raise_error(F.lit("duplicate panel key: a unit has two rows in one period"))
    return F.when(before == F.col("yr"), twice).otherwise(F.col("yr"))


def _entry(series: str, yr: str) -> Column:
    """The series' element of a period, NULL when the unit has no row there."""
    return F.get(F.filter(series, lambda x: x["yr"] == F.col(yr)), F.lit(0))


def pair_values(
    p: DataFrame,
    mode: str = "consecutive",
    years: Sequence[int] | None = None,
    pairs: DataFrame | None = None,
    by_unit_only: bool = False,
) -> DataFrame:
    """(group, unit, y1, y2, m1, m2, pct), one row per unit with a row in either period.

    Consecutive pairs look at the neighbouring rows of a unit only; all pairs and explicit
    ``pairs`` look up the other period in the unit's own series (one entry per period).
    ``by_unit_only`` partitions the panel by unit, which a later join on unit can reuse.
    """
    if years is not None:
        p = p.where(F.col("yr").isin(list(years)))
    if pairs is not None:
        chosen = TimePairs(pairs.select(*PAIR_KEYS), "custom")
    else:
        chosen = time_pairs(p, mode, years)
    if by_unit_only:
        p = p.repartition("unit")
    by_year = Window.partitionBy(*UNIT).orderBy("yr")
    item = F.struct("yr", "value")
    if chosen.mode == "consecutive":
        rows = p.withColumns({"_before": F.lag(item).over(by_year), "_after": F.lead(item).over(by_year)})
        rows = rows.withColumn("yr", unique_year(F.col("_before.yr")))
        first_other, second_other = F.col("_after"), F.col("_before")
        has_first = F.coalesce(second_other["yr"] == F.col("y1"), F.lit(False))
        m2 = F.when(first_other["yr"] == F.col("y2"), first_other["value"])
    else:
        whole = by_year.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = p.withColumns({"_series": F.collect_list(item).over(whole), "_before": F.lag("yr").over(by_year)})
        rows = rows.withColumn("yr", unique_year(F.col("_before"))).drop("_before")
        has_first = _entry("_series", "y1").isNotNull()
        m2 = _entry("_series", "y2")["value"]
    first = F.col("first")
    return (
        _with_roles(rows, chosen)
        .where(first | ~has_first)
        .select(
            *UNIT,
            "y1",
            "y2",
            F.when(first, F.col("value")).alias("m1"),
            F.when(first, m2).otherwise(F.col("value")).alias("m2"),
        )
        .withColumn("pct", relative_change("m1", "m2"))
    )


def presence(
    p: DataFrame, mode: str = "all", years: Sequence[int] | None = None
) -> DataFrame:
    """Units per (group, y1, y2, m1 missing?, m2 missing?) and their share of the pair's units.

    Units are first counted per presence pattern (the periods they have rows in), so the
    explosion over period pairs works on distinct patterns, not on units.
    """
    if years is not None:
        p = p.where(F.col("yr").isin(list(years)))
    item = F.struct("yr", F.col("value").isNull().alias("missing"))
    series = F.sort_array(F.collect_list(item))
    twice = F.raise_error(F.lit("duplicate panel key: a unit has two rows in one period"))
    patterns = (
        p.groupBy(*UNIT)
        .agg(F.when(F.count("yr") > F.size(F.collect_set("yr")), twice).otherwise(series).alias("_series"))
        .groupBy("group", "_series")
        .agg(F.count(F.lit(1)).alias("units"))
    )
    rows = patterns.select("group", "_series", "units", F.explode("_series").alias("_item")).select(
        "group", "_series", "units", "_item.yr", "_item.missing"
    )
    first = F.col("first")
    cells = (
        _with_roles(rows, time_pairs(p, mode, years))
        .where(first | _entry("_series", "y1").isNull())
        .select(
            *PAIR_KEYS,
            "units",
            F.when(first, F.col("missing")).otherwise(F.lit(True)).alias("m1_missing"),
            F.when(first, F.coalesce(_entry("_series", "y2")["missing"], F.lit(True)))
            .otherwise(F.col("missing"))
            .alias("m2_missing"),
        )
    )
    kinds = [(a, b) for a in (False, True) for b in (False, True)]

    def units_in(a: bool, b: bool) -> Column:
        here = (F.col("m1_missing") == a) & (F.col("m2_missing") == b)
        return F.sum(F.when(here, F.col("units")).otherwise(F.lit(0)))

    # one aggregation per pair; its four cells become rows without another shuffle
    wide = cells.groupBy(*PAIR_KEYS).agg(
        F.sum("units").alias("tot"),
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("m1_missing"),
                    F.lit(b).alias("m2_missing"),
                    units_in(a, b).alias("n"),
                )
                for a, b in kinds
            ]
        ).alias("_cells"),
    )
    return (
        wide.select(*PAIR_KEYS, "tot", F.inline("_cells"))
        .where(F.col("n") > 0)
        .withColumn("pct", ratio("n", "tot"))
    )


def _cell(m1_missing: bool, m2_missing: bool) -> Column:
    here = (F.col("m1_missing") == m1_missing) & (F.col("m2_missing") == m2_missing)
    return F.sum(F.when(here, F.col("n")).otherwise(F.lit(0)))


def jaccard(cells: DataFrame) -> DataFrame:
    """Units present in both periods over units with a row in either, from ``presence``."""
    return (
        cells.groupBy(*PAIR_KEYS)
        .agg(_cell(False, False).alias("both"), F.sum("n").alias("tot"))
        .withColumn("jaccard", ratio("both", "tot"))
    )


def churn(cells: DataFrame) -> DataFrame:
    """Units lost and gained per pair and their ratio, from ``presence``."""
    return (
        cells.groupBy(*PAIR_KEYS)
        .agg(_cell(False, True).alias("lost"), _cell(True, False).alias("gained"))
        .withColumn("ratio", ratio("gained", "lost"))
    )


def lost_units(p: DataFrame, first: int, last: int) -> DataFrame:
    """Units with a row in one of the two periods that have no value in the last one."""
    two = p.where(F.col("yr").isin(first, last))
    has_last = F.bool_or((F.col("yr") == last) & F.col("value").isNotNull())
    return two.groupBy(*UNIT).agg(has_last.alias("_has")).where(~F.col("_has")).select(*UNIT)


def units_per_period(p: DataFrame) -> DataFrame:
    return p.groupBy("group", "yr").agg(F.count(F.lit(1)).alias("n"))


def distinct_units(p: DataFrame) -> DataFrame:
    return p.groupBy("group").agg(F.countDistinct("unit").alias("n_units"))


def complete_cases(p: DataFrame, since: int | None = None) -> DataFrame:
    """Units with a value in every period (from ``since`` on)."""
    if since is not None:
        p = p.where(F.col("yr") >= since)
    n_years = p.agg(F.countDistinct("yr").alias("k")).scalar()
    return (
        p.groupBy(*UNIT)
        .agg(F.count("value").alias("n_values"))
        .where(F.col("n_values") == n_years)
        .select(*UNIT)
    )
