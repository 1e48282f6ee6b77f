"""Weighted means, exact quantiles, histograms, standard scores and linear regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bins import equal_width_bin
from ..functions.student import t_quantile, t_within
from ..functions.values import weighted_avg
from .scale import durable_table, join_on, running_totals


def weighted_means(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], weight: str
) -> DataFrame:
    """Weighted mean of every column per key."""
    return df.groupBy(*by).agg(*[weighted_avg(c, weight).alias(c) for c in columns])


def distribution(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Different values of a column per group in order, with the ranks each one holds: x, n, lo, hi, size.

    Value x stands at the 0-based ranks lo .. hi - 1 of the group's ``size`` values; missing values have
    no rank, and a group without any other keeps one row with a missing x. Rows are read once and
    counted before anything is ordered; minimum, mean, quantiles, whiskers and outliers are read from
    this table.
    """
    counts = df.groupBy(*by, F.col(column).cast("double").alias("x")).agg(F.count(column).alias("n"))
    ranked = running_totals(counts, by, [F.col("x").asc_nulls_first()], {"hi": F.col("n")}, whole={"hi": "size"})
    return ranked.withColumn("lo", F.col("hi") - F.col("n")).select(*by, "x", "n", "lo", "hi", "size")


def _quantile_parts(probs: dict[str, float]) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates over a distribution, and what combines them to linearly interpolated quantiles."""

    def at(position: Column) -> Column:
        """Value with the given 0-based rank: the one row whose rank range covers it."""
        return F.max(F.when((F.col("lo") <= position) & (position < F.col("hi")), F.col("x")))

    parts, out = [], {}
    for name, p in probs.items():
        h = (F.col("size") - 1) * F.lit(float(p))
        parts += [
            at(F.floor(h)).alias(f"_a_{name}"),
            at(F.ceil(h)).alias(f"_b_{name}"),
            F.max(h - F.floor(h)).alias(f"_f_{name}"),
        ]
        a, b, f = (F.col(f"_{k}_{name}") for k in "abf")
        out[name] = a + (b - a) * f
    return parts, out


def quantiles(
    df: DataFrame, by: Sequence[str], column: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of ``probs``.

    They are looked up in the running counts of the distinct values. No group is gathered in one
    task or buffer.
    """
    parts, out = _quantile_parts(probs)
    rows = distribution(df.where(F.col(column).isNotNull()), by, column)
    return rows.groupBy(*by).agg(*parts).select(*by, *[c.alias(k) for k, c in out.items()])


def quartiles(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """q1, q3 and their distance per group."""
    q = quantiles(df, by, column, {"q1": 0.25, "q3": 0.75})
    return q.withColumn("iqr", F.col("q3") - F.col("q1"))


MIDDLE = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def six_numbers(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Minimum, quartiles, median, mean and maximum per group, from one look at the rows."""
    parts, out = _quantile_parts(MIDDLE)
    kind = df.schema[column].dataType
    ends = [
        F.min("x").cast(kind).alias("lowest"),
        F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum("n")).alias("mean"),
        F.max("x").cast(kind).alias("highest"),
    ]
    rows = distribution(df, by, column).groupBy(*by).agg(*ends, *parts)
    return rows.select(*by, "lowest", "mean", "highest", *[c.alias(k) for k, c in out.items()])


def outliers(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    above: float | None = None,
    fence: float = 1.5,
) -> DataFrame:
    """Rows above a fixed threshold, or above q3 + fence * iqr, with their group's quartiles."""
    df = durable_table(df)
    rows = join_on(df, quartiles(df, by, column), by, "left", null_safe=True)
    limit = F.lit(above) if above is not None else F.col("q3") + fence * F.col("iqr")
    return rows.where(F.col(column) > limit)


def boxplot(df: DataFrame, by: Sequence[str], column: str, fence: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (furthest values inside the fences) and number of outliers per group.

    The rows are counted once; fences are then laid on the distinct values."""
    kind = df.schema[column].dataType
    values = durable_table(distribution(df.where(F.col(column).isNotNull()), by, column))
    parts, out = _quantile_parts(MIDDLE)
    q = values.groupBy(*by).agg(*parts).select(*by, *[c.alias(k) for k, c in out.items()])
    reach = fence * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        join_on(values, q, by, "left", null_safe=True)
        .groupBy(*by)
        .agg(
            *[F.any_value(s).alias(s) for s in MIDDLE],
            F.min(F.when(inside, F.col("x"))).cast(kind).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).cast(kind).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
    )


def histogram(df: DataFrame, by: Sequence[str], x: Column, bins: int = 15) -> DataFrame:
    """Row counts per key and equal-width bin over the range of all values."""
    values = df.select(*by, x.cast("double").alias("_x"))
    ends = values.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("ends"))
    return (
        values.withColumn("_ends", ends.scalar())
        .groupBy(*by, equal_width_bin("_x", F.col("_ends.lo"), F.col("_ends.hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale columns with their mean and sample standard deviation.

    The moments are one aggregated row, put into the plan as one scalar subquery.
    """
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).alias("moments")
    )
    scaled = {c: F.try_divide(F.col(c) - F.col(f"_m.m_{c}"), F.col(f"_m.s_{c}")) for c in columns}
    return df.withColumn("_m", moments.scalar()).withColumns(scaled).drop("_m")


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> LinearRegressionModel:
    """Least squares with intercept through the normal equations; only their p x p matrix
    reaches the driver. Rows with a missing value are left out.

    Fitting and its summary pass over the rows several times, so they are written once."""
    rows = df.select(F.col(y).cast("double").alias(y), *[F.col(x).cast("double").alias(x) for x in xs])
    fixed = durable_table(rows.na.drop())
    assembled = VectorAssembler(inputCols=list(xs), outputCol="features").transform(fixed)
    return LinearRegression(
        labelCol=y, featuresCol="features", solver="normal", standardization=False, regParam=0.0
    ).fit(assembled)


def ols_table(model: LinearRegressionModel, xs: Sequence[str], df: DataFrame, level: float = 0.95) -> DataFrame:
    """One row per term: estimate, standard error, confidence limits, p, with n, r2 and adjusted r2."""
    summary = model.summary
    rows = [
        (name, b, se, int(summary.numInstances), float(summary.r2), float(summary.r2adj), int(summary.degreesOfFreedom))
        for name, b, se in zip(
            [*xs, "(Intercept)"],
            [*[float(v) for v in model.coefficients], float(model.intercept)],
            [float(v) for v in summary.coefficientStandardErrors],
        )
    ]
    schema = "term string, estimate double, std_error double, n bigint, r2 double, r2_adj double, dof bigint"
    t = t_quantile(level, "dof") * F.col("std_error")
    return (
        df.sparkSession.createDataFrame(rows, schema)
        .withColumns({"ci_low": F.col("estimate") - t, "ci_high": F.col("estimate") + t})
        .withColumn("p_value", 1 - t_within(F.abs(F.try_divide("estimate", "std_error")), "dof"))
        .select("term", "estimate", "std_error", "ci_low", "ci_high", "p_value", "n", "r2", "r2_adj")
    )


def growth_regression(df: DataFrame, y: str) -> LinearRegressionModel:
    """The area model: y on area, income, low-rise share and high-rise share, all on
    standardised columns; each share is the sum of two standardised columns.

    The model table is read for its moments and for the fit, so it is written once."""
    table = durable_table(df)
    z = zscore(table, ["area", "income", "singd", "semd", "row", "apt"]).select(
        y,
        "area",
        "income",
        (F.col("singd") + F.col("semd")).alias("singd_semd"),
        (F.col("row") + F.col("apt")).alias("row_apt"),
    )
    return ols(z, y, MODEL_TERMS)


MODEL_TERMS = ["area", "income", "singd_semd", "row_apt"]


def regr_by(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    """Simple regression of y on x per key with what a confidence band needs."""
    return _fits(df, key, y, x).drop("first_x", "last_x")


def _fits(df: DataFrame, key: str, y: str, x: str) -> DataFrame:
    y_, x_ = F.col(y).cast("double"), F.col(x).cast("double")
    both = F.when(y_.isNotNull(), x_)
    fit = df.groupBy(key).agg(
        F.regr_slope(y_, x_).alias("slope"),
        F.regr_intercept(y_, x_).alias("intercept"),
        F.regr_r2(y_, x_).alias("r2"),
        F.regr_count(y_, x_).alias("n"),
        F.regr_avgx(y_, x_).alias("mean_x"),
        F.regr_sxx(y_, x_).alias("sxx"),
        F.regr_syy(y_, x_).alias("syy"),
        F.regr_sxy(y_, x_).alias("sxy"),
        F.min(both).alias("first_x"),
        F.max(both).alias("last_x"),
    )
    rss = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    error = F.sqrt(F.greatest(F.try_divide(rss, F.col("n") - 2), F.lit(0.0)))
    return fit.withColumn("resid_error", error).drop("syy", "sxy")


def confidence_band(
    df: DataFrame, key: str, y: str, x: str, points: int = 81, level: float = 0.95
) -> DataFrame:
    """The regression line of y on x per key with its confidence band on an even grid of x:
    key, x, fit, low, high.

    The grid runs from the smallest to the largest x of the fitted rows. With fewer than three
    rows there is no band, and with a single x no line.
    """
    fit = _fits(df, key, y, x).withColumn("_t", t_quantile(level, F.col("n") - 2))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_step")
    grid = fit.select("*", step).withColumn(
        "x", F.col("first_x") + (F.col("last_x") - F.col("first_x")) * F.col("_step") / (points - 1)
    )
    away = F.try_divide((F.col("x") - F.col("mean_x")) ** 2, F.col("sxx"))
    error = F.col("resid_error") * F.sqrt(1 / F.col("n") + away)
    line = F.col("intercept") + F.col("slope") * F.col("x")
    return grid.select(
        key,
        "x",
        line.alias("fit"),
        (line - F.col("_t") * error).alias("low"),
        (line + F.col("_t") * error).alias("high"),
    )


def model_table(
    changes: DataFrame,
    layer: DataFrame,
    profile: DataFrame,
    levels: DataFrame,
    area: str,
    housing: Sequence[str] = ("singd", "semd", "row", "apt"),
) -> DataFrame:
    """Area changes with size, weighted profile means, level and housing shares.

    changes(area, d_m, ...), layer(area, area size), profile(area, means), levels(area, level).
    """
    from .profile import row_shares

    joined = changes
    for other in (layer, profile, levels):
        joined = join_on(joined, other, [area], "left", null_safe=True)
    return row_shares(joined, list(housing))
