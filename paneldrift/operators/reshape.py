"""Reshaping, set operations and row pickers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_number
from ..functions.values import ratio, strict_sum
from .scale import join_on, numbered, running_totals


def pivot_values(
    df: DataFrame,
    ids: Sequence[str],
    label: str,
    value: str,
    labels: Sequence[object],
    agg: Callable[[Column], Column] = F.sum,
    prefix: str = "",
) -> DataFrame:
    """Long to wide on a known label list; a missing cell is NULL."""
    return df.groupBy(*ids).agg(
        *[agg(F.when(F.col(label) == x, F.col(value))).alias(f"{prefix}{x}") for x in labels]
    )


def labels_of(df: DataFrame, label: str, most: int = 1000) -> list[object]:
    """The different labels of a column in order, missing ones left out.

    They become columns, so there must be few: with more than ``most`` this is an error, and no more
    than that many reach the driver."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.lit(1)).select(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {label} has more than {most} labels")
    return sorted(r[0] for r in rows)


def pivot_found(
    df: DataFrame,
    ids: Sequence[str],
    label: str,
    value: str,
    agg: Callable[[Column], Column] = F.sum,
    prefix: str = "",
    most: int = 1000,
) -> DataFrame:
    """Long to wide on the labels that the data hold: one job finds them, the plan is then made for them."""
    labels = labels_of(df, label, most)
    if not labels:
        return df.select(*ids).distinct()
    return pivot_values(df, ids, label, value, labels, agg, prefix)


def select_matching(df: DataFrame, keep: Sequence[str], pattern: str) -> DataFrame:
    """The named columns and all whose name contains the pattern."""
    names = [c for c in columns_matching(df, pattern) if c not in keep]
    return df.select(*keep, *[F.col(f"`{c}`") for c in names])


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that contain the pattern."""
    return [c for c in df.columns if re.search(pattern, c)]


def sum_matching(df: DataFrame, by: Sequence[str], pattern: str) -> DataFrame:
    """NULL-propagating sums of all columns whose name contains the pattern."""
    names = columns_matching(df, pattern)
    return df.groupBy(*by).agg(*[strict_sum(F.col(f"`{c}`")).alias(c) for c in names])


def union_tagged(frames: dict[str, DataFrame], tag: str = "tt") -> DataFrame:
    """Stack frames by column name with a constant tag column; absent columns become NULL."""
    out = None
    for label, df in frames.items():
        one = df.withColumn(tag, F.lit(label))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def stack_external(
    frames: dict[str, DataFrame], value: str, key: str = "year", name: str = "pop", tag: str = "city"
) -> DataFrame:
    """External tables of one series each, under one another: tag, key, name.

    The value column is text with thousands commas and footnotes; only it and the key are kept."""
    clean = {
        label: df.select(F.col(key).try_cast("int").alias(key), plain_number(value).alias(name))
        for label, df in frames.items()
    }
    return union_tagged(clean, tag).select(tag, key, name)


def except_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of a that b does not have."""
    return join_on(a.select(*keys).distinct(), b.select(*keys).distinct(), keys, "left_anti", null_safe=True)


def collect_string(
    df: DataFrame, by: Sequence[str], column: str, name: str, separator: str = ", "
) -> DataFrame:
    """The group's values in ascending order as one text. Meant for groups bounded by design,
    such as the periods of a unit: the text of a group is one cell."""
    items = F.transform(F.array_sort(F.collect_list(column)), lambda x: x.cast("string"))
    return df.groupBy(*by).agg(F.array_join(items, separator).alias(name))


def top_k_signed(
    df: DataFrame, value: str, k: int, within: Sequence[str], name: str
) -> DataFrame:
    """The k largest gains and k largest losses per key; ties go to the smaller name.

    The rank filter lets Spark keep k rows per group in every task before the shuffle.
    """
    signed = df.where(F.col(value) != 0).withColumn(
        "sign", F.when(F.col(value) > 0, "Gain").otherwise("Loss")
    )
    best = Window.partitionBy("sign", *within).orderBy(F.abs(value).desc(), F.col(name).asc())
    return signed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hash_sample(
    df: DataFrame, unit: str, n: int, by: Sequence[str], seed: int = 0
) -> DataFrame:
    """n rows per group, chosen by a hash of the unit: the same rows on every run."""
    key = F.md5(F.concat_ws(":", F.col(unit).cast("string"), F.lit(str(seed))))
    order = Window.partitionBy(*by).orderBy(key, F.col(unit))
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def rank_fraction(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "fraction"
) -> DataFrame:
    """Position in the ordered group over the group's size, for groups of any size."""
    rows = running_totals(df, by, order, {"rn": F.lit(1).cast("bigint")}, whole={"rn": "_n"})
    return rows.withColumn(name, ratio("rn", "_n")).drop("_n")


def category_order(
    df: DataFrame, category: str, value: str, name: str = "ord", within: Sequence[str] = ()
) -> DataFrame:
    """Categories with their largest total of a group (``within``) and their 1-based position by it.

    Totals are sorted in descending order, ties by name, and a category takes the place of its
    first total.
    """
    totals = df.groupBy(*within, category).agg(F.sum(value).alias("tot"))
    totals = totals.groupBy(category).agg(F.max("tot").alias("tot"))
    return numbered(
        totals, [], [F.col("tot").desc_nulls_last(), F.col(category).asc_nulls_last()], name
    )
