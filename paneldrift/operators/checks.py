"""Data-quality checks. Each one returns the violations; an empty result means the check holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reshape import except_keys
from .scale import join_on


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unknown_keys(df: DataFrame, dictionary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of df that the dictionary does not have."""
    return except_keys(df, dictionary, keys)


def disagreements(
    a: DataFrame, b: DataFrame, keys: Sequence[str], a_name: str, b_name: str
) -> DataFrame:
    """Keys for which two sources name different things, where both name one."""
    left = a.select(*keys, F.col(a_name).alias("name_a")).distinct()
    right = b.select(*keys, F.col(b_name).alias("name_b")).distinct()
    return join_on(left, right, keys, "inner", null_safe=False).where(
        F.col("name_a") != F.col("name_b")
    )


def block_sizes(df: DataFrame, key: str, expected: int | None = None) -> DataFrame:
    """Blocks whose row count differs from the expected one (default: the most frequent count)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if expected is not None:
        usual = F.lit(expected).cast("bigint")
    else:
        usual = (
            sizes.groupBy("n")
            .agg(F.count(F.lit(1)).alias("k"))
            .agg(F.max_by("n", F.struct("k", (-F.col("n")).alias("m"))).alias("usual"))
            .scalar()
        )
    return sizes.withColumn("expected", usual).where(F.col("n") != F.col("expected"))


def repeated_terms(long: DataFrame, key: str, term: str) -> DataFrame:
    """(block, term) combinations that do not occur exactly once."""
    return duplicate_keys(long, [key, term])


def row_count_gap(df: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Rows against expected units: one row (n_rows, n_units) when the numbers differ."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"))
    expected = units.agg(F.countDistinct(key).alias("n_units"))
    return counts.withColumn("n_units", expected.scalar()).where(
        F.col("n_rows") != F.col("n_units")
    )


def unassigned(df: DataFrame, column: str) -> DataFrame:
    """Rows without a label."""
    return df.where(F.coalesce(F.col(column), F.lit("")) == "")


def version_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Frequency of value differences between two versions of a table (a left join b)."""
    newer = a.select(*keys, F.col(value).alias("_a"))
    older = b.select(*keys, F.col(value).alias("_b"))
    return (
        join_on(newer, older, keys, "left", null_safe=False)
        .groupBy((F.col("_a") - F.col("_b")).alias("diff"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


class CheckFailed(AssertionError):
    """A data-quality check found violations."""


def assert_empty(violations: DataFrame, message: str) -> None:
    """Raise when there is a violation; only a few example rows reach the driver."""
    sample = violations.limit(3).collect()
    if sample:
        raise CheckFailed(f"{message}: {[r.asDict() for r in sample]}")
