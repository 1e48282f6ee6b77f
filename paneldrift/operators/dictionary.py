"""Unit dictionaries: hierarchy, many-to-many bridge and most common entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_suffix
from ..functions.values import strict_avg
from .scale import durable_table, join_on, left_join_many


def clean_bridge(bridge: DataFrame, unit: str = "unit") -> DataFrame:
    """Keep bridge rows whose unit id is made of digits only and cast it."""
    return bridge.where(~F.col(unit).rlike("[^0-9]")).withColumn(
        unit, F.col(unit).try_cast("bigint")
    )


def bridge_join(dictionary: DataFrame, bridge: DataFrame, cities: DataFrame) -> DataFrame:
    """dictionary left join bridge (on unit) left join cities (on postcode).

    A missing postcode matches a missing postcode. The bridge's own area name arrives as
    ``csd_bridge``.
    """
    renamed = bridge.withColumnRenamed("csd", "csd_bridge")
    linked = left_join_many(dictionary, renamed, ["unit"])
    return join_on(linked, cities, ["postcode"], "left", null_safe=True)


def frequent_values(df: DataFrame, column: str, more_than: int) -> DataFrame:
    """Values that occur more than n times, with their counts; NULL is dropped."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > more_than)
    )


def build_dictionary(
    dictionary: DataFrame,
    bridge: DataFrame,
    cities: DataFrame,
    units: DataFrame,
    core: str,
    min_count: int = 10,
) -> DataFrame:
    """Bridge rows of the panel's units with an alternative area name ``csd_alt``.

    Inside the area ``core`` the city name is used when it has more than ``min_count`` rows,
    else the core's own name; outside it csd_alt is the area itself.
    """
    known = dictionary.withColumns({"csd": strip_suffix("csd"), "ccsd": strip_suffix("ccsd")})
    known = join_on(known, units.select("unit").distinct(), ["unit"], "left_semi", null_safe=False)
    # read twice below (name counts and rows), so it is written once
    linked = durable_table(bridge_join(known, clean_bridge(bridge), cities).drop("csd_bridge"))
    named = linked.withColumn("_name", F.coalesce("city", "csd")).drop("city")
    in_core = F.col("csd") == core
    frequent = frequent_values(named.where(in_core), "_name", min_count)
    marked = join_on(
        named, frequent.select("_name", F.lit(True).alias("_frequent")), ["_name"], "left"
    )
    alt = F.when(in_core, F.when(F.col("_frequent"), F.col("_name")).otherwise(core)).otherwise(
        F.col("csd")
    )
    return marked.withColumn("csd_alt", alt).drop("_name", "_frequent")


def most_common(df: DataFrame, unit: str, columns: Sequence[str], count: str = "n") -> DataFrame:
    """Most frequent combination of columns per unit; ties go to the smallest one, NULLs last.

    Counting combines on the map side and picking is an aggregate over the counts, so neither
    step sorts or gathers the rows of a unit.
    """
    counts = df.groupBy(unit, *columns).agg(F.count(F.lit(1)).alias(count))
    rank: list[Column] = [(-F.col(count)).alias("_neg")]
    for i, c in enumerate(columns):
        rank += [F.col(c).isNull().alias(f"_null{i}"), F.col(c).alias(c)]
    best = counts.groupBy(unit).agg(F.min(F.struct(*rank)).alias("_best"))
    return best.select(
        unit, *[F.col(f"_best.{c}").alias(c) for c in columns], (-F.col("_best._neg")).alias(count)
    )


def mean_coordinates(
    bridge: DataFrame, unit: str, columns: Sequence[str], skip_missing: bool = False
) -> DataFrame:
    """Mean position of a unit over its bridge rows: NULL with any missing value, or skipping them."""
    mean = F.avg if skip_missing else strict_avg
    return bridge.groupBy(unit).agg(*[mean(c).alias(c) for c in columns])
