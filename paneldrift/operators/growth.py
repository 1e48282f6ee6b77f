"""Totals, indices, growth rates, cohorts, decomposition and counterfactual curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import as_index, filled, growth, net_change, strict_sum
from .pairs import PAIR_KEYS, UNIT
from .scale import join_on

# Labels of the decomposition and of the counterfactual curves.
DENSITY, NEW, LOST = "Density", "New DAs", "Lost DAs"
PART_ORDER = [DENSITY, NEW, LOST]
ACTUAL, NET_UNITS = "Actual", "Net DAs"
CURVE_ORDER = [DENSITY, NET_UNITS, ACTUAL]


def period_totals(p: DataFrame) -> DataFrame:
    """(group, yr, pop); NULL where a unit of the period has a NULL value."""
    return p.groupBy("group", "yr").agg(strict_sum("value").alias("pop"))


def index_series(
    agg: DataFrame, by: Sequence[str], order: str, value: str, name: str = "idx"
) -> DataFrame:
    """Value relative to the first period of its series (= 100).

    ``agg`` is an aggregate series, one row per period: the window is as long as the calendar.
    """
    first = F.first(value).over(Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()))
    return agg.withColumn(name, as_index(value, first))


def stacked_index(
    series: dict[str, DataFrame], index_only: Sequence[str] = (), scale: float = 1.0
) -> DataFrame:
    """Several (group, yr, pop) series with their indices, stacked and long: group, yr, tt, measure, value.

    Series named in ``index_only`` (external ones, whose level has nothing to do with the others')
    keep their index alone; the levels of the others are divided by ``scale``.
    """
    out = None
    for label, df in series.items():
        one = index_series(df.select("group", "yr", "pop"), ["group"], "yr", "pop").withColumn(
            "tt", F.lit(label)
        )
        out = one if out is None else out.unionByName(one)
    long = out.select(
        "group", "yr", "tt", (F.col("pop") / scale).cast("double").alias("pop"), "idx"
    ).unpivot(["group", "yr", "tt"], ["pop", "idx"], "measure", "value")
    return long.where(~((F.col("measure") == "pop") & F.col("tt").isin(list(index_only))))


def reconcile(reference: DataFrame, units: DataFrame) -> DataFrame:
    """Reported total against the sum of units, both (group, yr, pop): err = reported / sum - 1."""
    a = reference.select("group", "yr", F.col("pop").alias("reported"))
    b = units.select("group", "yr", F.col("pop").alias("summed"))
    return join_on(a, b, ["group", "yr"], "full", null_safe=True).withColumn(
        "err", growth("summed", "reported")
    )


def growth_like_for_like(pv: DataFrame) -> DataFrame:
    """Growth over the units that have a defined change in the pair."""
    return (
        pv.where(F.col("pct").isNotNull())
        .groupBy(*PAIR_KEYS)
        .agg(strict_sum("m1").alias("m1"), strict_sum("m2").alias("m2"))
        .withColumn("growth", growth("m1", "m2"))
    )


def growth_pairs_total(pv: DataFrame) -> DataFrame:
    """Growth of the summed pair values, missing values included (NULL when there are any)."""
    return (
        pv.groupBy(*PAIR_KEYS)
        .agg(strict_sum("m1").alias("m1"), strict_sum("m2").alias("m2"))
        .withColumn("growth", growth("m1", "m2"))
    )


def growth_aggregate(agg: DataFrame) -> DataFrame:
    """Growth of an aggregate series (group, yr, pop) from one period to the next."""
    by_year = Window.partitionBy("group").orderBy("yr")
    return (
        agg.select(
            "group",
            F.lag("yr").over(by_year).alias("y1"),
            F.col("yr").alias("y2"),
            F.lag("pop").over(by_year).alias("m1"),
            F.col("pop").alias("m2"),
        )
        .withColumn("growth", growth("m1", "m2"))
        .na.drop()
    )


def growth_compare(actual: DataFrame, like_for_like: DataFrame) -> DataFrame:
    """Actual and like-for-like growth of the same pair, long: group, y1, y2, tt, growth."""
    a = actual.select(*PAIR_KEYS, F.col("growth").alias("growth.act"))
    b = like_for_like.select(*PAIR_KEYS, F.col("growth").alias("growth.DA"))
    wide = join_on(a, b, PAIR_KEYS, "left", null_safe=True)
    return wide.unpivot(PAIR_KEYS, ["`growth.act`", "`growth.DA`"], "name", "growth").select(
        *PAIR_KEYS, F.split_part("name", F.lit("."), F.lit(2)).alias("tt"), "growth"
    )


def _years(p: DataFrame, years: Sequence[int] | None) -> Column:
    """All periods as one sorted array: given, or one scalar subquery over the time column."""
    if years is not None:
        return F.array(*[F.lit(y) for y in sorted(years)])
    return p.agg(F.sort_array(F.collect_set("yr")).alias("ys")).scalar()


def cohort_index(
    p: DataFrame, base: str = "first", years: Sequence[int] | None = None
) -> DataFrame:
    """Total of all periods over the units that had a value in an index period.

    (group, iyear, yr, pop, idx) for every index period but the last. Missing values count
    as zero. ``base`` sets which total is 100: the first panel period or the index period.
    """
    if base not in ("first", "cohort"):
        raise ValueError("base is 'first' or 'cohort'")
    series = F.collect_list(F.struct("yr", "value"))
    twice = F.raise_error(F.lit("duplicate panel key: a unit has two rows in one period"))
    series = F.when(F.count("yr") > F.size(F.collect_set("yr")), twice).otherwise(series)
    units = p.groupBy(*UNIT).agg(series.alias("_series"))
    members = units.select("group", "_series", F.explode("_series").alias("_i")).where(
        F.col("_i.value").isNotNull()
    )
    sums = (
        members.select("group", F.col("_i.yr").alias("iyear"), F.explode("_series").alias("_x"))
        .groupBy("group", "iyear", F.col("_x.yr").alias("yr"))
        .agg(F.sum(filled("_x.value")).alias("pop"))
    )
    # from here on one row per (group, iyear, yr): fill the calendar with zero totals
    filled_rows = (
        sums.groupBy("group", "iyear")
        .agg(F.map_from_entries(F.collect_list(F.struct("yr", "pop"))).alias("_pops"))
        .withColumn("_ys", _years(p, years))
        .where(F.col("iyear") < F.array_max("_ys"))
    )
    anchor = F.array_min("_ys") if base == "first" else F.col("iyear")
    return (
        filled_rows.select(
            "group",
            "iyear",
            filled(F.try_element_at("_pops", anchor)).alias("_base"),
            "_pops",
            F.explode("_ys").alias("yr"),
        )
        .withColumn("pop", filled(F.try_element_at("_pops", F.col("yr"))))
        .select("group", "iyear", "yr", "pop", as_index("pop", "_base").alias("idx"))
    )


def cohort_curves(p: DataFrame) -> DataFrame:
    """Cohort indices and, as series "Actual", the index of all units: group, series, yr, pop, idx.

    All are based on the first period of the panel, the actual one on the group's first."""
    cohorts = cohort_index(p).withColumn("series", F.col("iyear").cast("string"))
    totals = p.groupBy("group", "yr").agg(filled(F.sum("value")).alias("pop"))
    first = totals.groupBy("group").agg(F.min_by("pop", "yr").alias("_base"))
    actual = join_on(totals, first, ["group"], null_safe=True).select(
        "group", F.lit(ACTUAL).alias("series"), "yr", "pop", as_index("pop", "_base").alias("idx")
    )
    return cohorts.select(*actual.columns).unionByName(actual)


def decompose(pv: DataFrame) -> DataFrame:
    """Change per pair split into existing, new and lost units: group, y1, y2, tt, dd, change."""
    has1, has2 = F.col("m1").isNotNull(), F.col("m2").isNotNull()
    d = net_change("m1", "m2")
    kinds = {DENSITY: has1 & has2, LOST: has1 & ~has2, NEW: ~has1}
    # one aggregation per pair; its parts become rows without another shuffle
    wide = pv.groupBy(*PAIR_KEYS).agg(
        F.sum(d).alias("change"),
        F.array(
            *[
                F.struct(
                    F.lit(label).alias("tt"),
                    F.sum(F.when(kind, d)).alias("dd"),
                )
                for label, kind in kinds.items()
            ]
        ).alias("_parts"),
    )
    return (
        wide.select(*PAIR_KEYS, "change", F.inline("_parts"))
        .where(F.col("dd").isNotNull())
        .select(*PAIR_KEYS, "tt", "dd", "change")
    )


def counterfactual(decomposed: DataFrame, totals: DataFrame) -> DataFrame:
    """First total plus the running change: as it was, with density change only, with unit change only.

    group, tt, yr, pop. A period without new or lost units adds zero to the net unit curve.
    """

    def part(label: str) -> Column:
        return F.sum(F.when(F.col("tt") == label, F.col("dd")).otherwise(F.lit(0)))

    wide = decomposed.groupBy(*PAIR_KEYS).agg(
        F.sum("dd").alias(ACTUAL),
        part(DENSITY).alias(DENSITY),
        (part(NEW) + part(LOST)).alias(NET_UNITS),
    )
    labels = [ACTUAL, DENSITY, NET_UNITS]
    steps = wide.unpivot(PAIR_KEYS, labels, "tt", "dd").select(
        "group", "tt", F.col("y2").alias("yr"), "dd"
    )
    base = totals.groupBy("group").agg(
        F.min("yr").alias("_base_yr"), F.min_by("pop", "yr").alias("_base")
    )
    start = base.select(
        "group",
        F.explode(F.array(*[F.lit(x) for x in labels])).alias("tt"),
        F.col("_base_yr").alias("yr"),
        F.lit(0).cast("bigint").alias("dd"),
    )
    # one row per label and period: the window is as long as the calendar
    so_far = Window.partitionBy("group", "tt").orderBy("yr").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    curve = start.unionByName(steps).withColumn("_cum", F.sum("dd").over(so_far))
    return join_on(curve, base, ["group"], null_safe=True).select(
        "group", "tt", "yr", (F.col("_base") + F.col("_cum")).alias("pop")
    )


def cumulative(df: DataFrame, by: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Running sum of an aggregate series, one row per period."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return df.withColumn(name, F.sum(value).over(so_far))


def complete_grid(p: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Every unit in every period; value is NULL where there was no row."""
    units = p.groupBy(*UNIT).agg(F.collect_list(F.struct("yr", "value")).alias("_series"))
    return (
        units.withColumn("_ys", _years(p, years))
        .select(*UNIT, "_series", F.explode("_ys").alias("yr"))
        .select(
            *UNIT,
            "yr",
            F.get(F.filter("_series", lambda x: x["yr"] == F.col("yr")), F.lit(0))["value"].alias(
                "value"
            ),
        )
    )


def period_delta(p: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Change from period to period over the completed grid, missing = 0, NULL in the first period."""
    grid = complete_grid(p, years).withColumn("value", filled("value"))
    by_year = Window.partitionBy(*UNIT).orderBy("yr")
    return grid.withColumn("delta", F.col("value") - F.lag("value").over(by_year))


def first_last_change(
    p: DataFrame, first: int | Column | None = None, last: int | Column | None = None
) -> DataFrame:
    """Change of every unit from the first to the last period, missing = 0."""
    if first is None:
        first = p.agg(F.min("yr").alias("a")).scalar()
    if last is None:
        last = p.agg(F.max("yr").alias("b")).scalar()
    v1 = F.sum(F.when(F.col("yr") == first, F.col("value")))
    v2 = F.sum(F.when(F.col("yr") == last, F.col("value")))
    return (
        p.groupBy(*UNIT)
        .agg(filled(v1).alias("v_first"), filled(v2).alias("v_last"))
        .withColumn("d_m", F.col("v_last") - F.col("v_first"))
    )


def missing_per_period(p: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Units of the group without a value in a period.

    units - values per period: no grid is built, the calendar is filled on aggregated rows.
    """
    per_year = p.groupBy("group", "yr").agg(F.count("value").alias("_n"))
    units = p.groupBy("group").agg(F.countDistinct("unit").alias("_units"))
    have = per_year.groupBy("group").agg(
        F.map_from_entries(F.collect_list(F.struct("yr", "_n"))).alias("_have")
    )
    return (
        join_on(units, have, ["group"], null_safe=True)
        .withColumn("_ys", _years(p, years))
        .select("group", "_units", "_have", F.explode("_ys").alias("yr"))
        .select(
            "group",
            "yr",
            (F.col("_units") - filled(F.try_element_at("_have", F.col("yr")))).alias("n_missing"),
        )
    )

