"""Student's t distribution, confidence bands and the distribution table."""

from __future__ import annotations

import random
import shutil
import statistics

import pytest
from pyspark.sql import functions as F

from paneldrift.functions.student import t_density, t_quantile, t_within
from paneldrift.operators import stats as M


def test_t_distribution_against_a_library(spark):
    library = spark._jvm.org.apache.commons.math3.distribution.TDistribution
    dofs = [1, 2, 3, 4, 5, 8, 9, 30, 137, 200, 201, 5000]
    frame = spark.createDataFrame([(d,) for d in dofs], "d bigint")
    for level in (0.5, 0.95, 0.999):
        for r in frame.select("d", t_quantile(level, "d").alias("q")).collect():
            assert r["q"] == pytest.approx(library(float(r["d"])).inverseCumulativeProbability(0.5 + level / 2), rel=1e-8)
    for t in (0.0, 0.4, 2.0, 9.0):
        for r in frame.select("d", t_within(F.lit(t), "d").alias("p"), t_density(F.lit(t), "d").alias("f")).collect():
            assert r["p"] == pytest.approx(2 * library(float(r["d"])).cumulativeProbability(t) - 1, abs=1e-11)
            assert r["f"] == pytest.approx(library(float(r["d"])).density(t), rel=1e-9)
    none = spark.createDataFrame([(0,), (None,)], "d bigint").select(t_quantile(0.9, "d"), t_within(F.lit(1.0), "d"))
    assert [tuple(r) for r in none.collect()] == [(None, None)] * 2


def test_confidence_band(spark):
    rnd = random.Random(1)
    points = [("a", float(x), 2.0 * x + rnd.gauss(0, 1)) for x in range(12)] + [("b", 1.0, 1.0), ("b", 2.0, 5.0), ("c", 1.0, None)]
    band = M.confidence_band(spark.createDataFrame(points, "k string, x double, y double"), "k", "y", "x", points=3).collect()
    xs, ys = [p[1] for p in points[:12]], [p[2] for p in points[:12]]
    slope, intercept = statistics.linear_regression(xs, ys)
    rest = sum((y - intercept - slope * x) ** 2 for x, y in zip(xs, ys))
    mean, sxx = statistics.fmean(xs), sum((x - statistics.fmean(xs)) ** 2 for x in xs)
    for r in (r for r in band if r["k"] == "a"):
        error = (rest / 10 * (1 / 12 + (r["x"] - mean) ** 2 / sxx)) ** 0.5
        assert r["fit"] == pytest.approx(intercept + slope * r["x"])
        assert r["high"] - r["fit"] == pytest.approx(2.2281388519649385 * error)
        assert r["fit"] - r["low"] == pytest.approx(2.2281388519649385 * error)
    assert sorted(r["x"] for r in band if r["k"] == "a") == [0.0, 5.5, 11.0]
    assert [(r["fit"], r["low"]) for r in band if r["k"] == "b"] == [(1.0, None), (3.0, None), (5.0, None)]
    assert all(r["fit"] is None for r in band if r["k"] == "c")


def test_distribution_holds_every_rank(spark):
    values = [("a", v) for v in (3, 1, 3, 3, None, 9, 1)] + [("b", None), (None, 4)]
    frame = spark.createDataFrame(values, "k string, v int")
    table = M.distribution(frame, ["k"], "v")
    got = sorted(tuple(r) for r in table.where("k = 'a' AND x IS NOT NULL").collect())
    assert got == [("a", 1.0, 2, 0, 2, 6), ("a", 3.0, 3, 2, 5, 6), ("a", 9.0, 1, 5, 6, 6)]
    six = {r["k"]: r for r in M.six_numbers(frame, ["k"], "v").collect()}
    assert (six["a"]["lowest"], six["a"]["q1"], six["a"]["median"], six["a"]["highest"]) == (1, 1.5, 3.0, 9)
    assert six["a"]["mean"] == pytest.approx(20 / 6) and six["b"]["mean"] is None and six["b"]["lowest"] is None
    assert six[None]["median"] == 4.0
    box = {r["k"]: r for r in M.boxplot(frame, ["k"], "v").collect()}
    assert (box["a"]["whisker_low"], box["a"]["whisker_high"], box["a"]["n_outliers"]) == (1, 3, 1)


def test_statistics_scan_the_rows_once(spark, tmp_path):
    """Once the values are counted, the table of rows is not needed any more."""
    spark.range(50).selectExpr("id % 3 AS k", "id AS v").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    made = [f(df, ["k"], "v") for f in (M.six_numbers, M.boxplot)]
    shutil.rmtree(f"{tmp_path}/t")
    assert [m.count() for m in made] == [3, 3]
