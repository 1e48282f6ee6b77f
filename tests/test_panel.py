"""The hand-computed panel: NULL, zero, lost, new and equal cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from paneldrift.operators import classes as C
from paneldrift.operators import growth as G
from paneldrift.operators import pairs as P

from conftest import rows


@pytest.fixture(scope="module")
def panel(spark):
    data = [
        ("T", 1, 1971, 10), ("T", 1, 1981, 12), ("T", 1, 1991, 8),
        ("T", 2, 1971, 5),
        ("T", 3, 1981, 7), ("T", 3, 1991, 7),
        ("T", 4, 1971, 0), ("T", 4, 1981, 4), ("T", 4, 1991, None),
    ]
    return spark.createDataFrame(data, "group string, unit bigint, yr int, value bigint").cache()


@pytest.fixture(scope="module")
def pv(panel):
    return P.pair_values(panel).cache()


def test_strict_totals(panel):
    assert rows(G.period_totals(panel)) == [("T", 1971, 15), ("T", 1981, 23), ("T", 1991, None)]


def test_presence_and_jaccard(panel):
    cells = P.presence(panel)
    got = {(r["y1"], r["y2"]): (r["both"], r["tot"], r["jaccard"]) for r in P.jaccard(cells).collect()}
    assert got[(1971, 1981)] == (2, 4, 0.5)
    assert got[(1981, 1991)] == (2, 3, pytest.approx(2 / 3))
    assert got[(1971, 1991)] == (1, 4, 0.25)
    churned = {(r["y1"], r["y2"]): (r["lost"], r["gained"]) for r in P.churn(cells).collect()}
    assert churned == {(1971, 1981): (1, 1), (1981, 1991): (1, 0), (1971, 1991): (2, 1)}


def test_presence_keeps_the_missing_both_cell(spark):
    data = [("T", 1, 1, None), ("T", 1, 2, None), ("T", 2, 1, 3), ("T", 2, 2, 4)]
    p = spark.createDataFrame(data, "group string, unit bigint, yr int, value bigint")
    cells = P.presence(p)
    assert rows(cells, "m1_missing", "m2_missing", "n", "tot") == [
        (False, False, 1, 2),
        (True, True, 1, 2),
    ]
    assert P.jaccard(cells).first()["jaccard"] == 0.5


def test_relative_change(pv):
    got = {r["unit"]: r["pct"] for r in pv.where("y1 = 1971").collect()}
    assert got[1] == pytest.approx(0.2)
    assert got[2] is None and got[3] is None
    assert math.isinf(got[4])


def test_all_pairs_hold_the_consecutive_ones(panel, pv):
    every = P.pair_values(panel, "all")
    assert rows(every.where("y2 - y1 = 10"), *pv.columns) == rows(pv)
    assert every.where("y1 = 1971 and y2 = 1991").count() == 4


def test_growth_like_for_like(pv):
    got = {r["y1"]: (r["m1"], r["m2"], r["growth"]) for r in G.growth_like_for_like(pv).collect()}
    assert got[1971] == (10, 16, pytest.approx(0.6))
    assert got[1981] == (19, 15, pytest.approx(-4 / 19))


def test_decomposition(pv):
    assert rows(G.decompose(pv), "y1", "tt", "dd", "change") == [
        (1971, "Density", 6, 8),
        (1971, "Lost DAs", -5, 8),
        (1971, "New DAs", 7, 8),
        (1981, "Density", -4, -8),
        (1981, "Lost DAs", -4, -8),
    ]


def test_sign_counts_and_gain_loss(pv):
    assert rows(C.sign_counts(pv).where("y2 = 1991"), "sign", "n") == [("Loss", 1), ("No Change", 1)]
    assert rows(C.gain_loss(pv).where("y2 = 1991"), "tt", "d") == [
        ("Gain", 0), ("Loss", -4), ("Net", -4),
    ]


def test_change_classes(pv):
    got = rows(C.change_class(pv).where("y1 = 1981"), "unit", "tt", "d_m")
    assert got == [(1, "Lost Density", -4), (3, "New Density", 0), (4, "Lost DA", -4)]


def test_class_of_a_pair_without_values_is_null(spark):
    p = spark.createDataFrame(
        [("T", 1, 1, None), ("T", 1, 2, None)], "group string, unit bigint, yr int, value bigint"
    )
    assert rows(C.change_class(P.pair_values(p)), "tt", "d_m") == [(None, 0)]
    assert rows(G.decompose(P.pair_values(p)), "tt", "dd") == [("New DAs", 0)]


@pytest.mark.parametrize("base", ["first", "cohort"])
def test_cohort_index(panel, base):
    got = {(r["iyear"], r["yr"]): (r["pop"], r["idx"]) for r in G.cohort_index(panel, base).collect()}
    assert [got[(1971, y)][0] for y in (1971, 1981, 1991)] == [15, 16, 8]
    assert got[(1971, 1981)][1] == pytest.approx(106.666667)
    assert [got[(1981, y)][0] for y in (1971, 1981, 1991)] == [10, 23, 15]
    if base == "first":
        assert [got[(1981, y)][1] for y in (1971, 1981, 1991)] == pytest.approx([100, 230, 150])
    else:
        assert got[(1981, 1981)][1] == pytest.approx(100)
    assert not any(k[0] == 1991 for k in got)


def test_counterfactual(panel, pv):
    curves = G.counterfactual(G.decompose(pv), G.period_totals(panel))
    got = {}
    for r in curves.orderBy("tt", "yr").collect():
        got.setdefault(r["tt"], []).append(r["pop"])
    assert got == {"Actual": [15, 23, 15], "Density": [15, 21, 17], "Net DAs": [15, 17, 13]}


def test_grid_and_deltas(panel):
    grid = G.complete_grid(panel)
    assert grid.count() == 12
    assert grid.where("value is null").count() == 4
    deltas = G.period_delta(panel)
    assert rows(deltas.where("unit = 1"), "yr", "value", "delta") == [
        (1971, 10, None), (1981, 12, 2), (1991, 8, -4),
    ]
    assert rows(G.first_last_change(panel), "unit", "d_m") == [(1, -2), (2, -5), (3, 7), (4, 0)]
    assert rows(G.missing_per_period(panel), "yr", "n_missing") == [(1971, 1), (1981, 1), (1991, 2)]
    assert rows(P.complete_cases(panel), "unit") == [(1,)]
    assert rows(P.complete_cases(panel, 1981), "unit") == [(1,), (3,)]


def test_lost_units(panel):
    assert rows(P.lost_units(panel, 1971, 1991), "unit") == [(2,), (4,)]


def test_index_and_growth_of_a_series(spark):
    agg = spark.createDataFrame([("T", 1, 50), ("T", 2, 75), ("T", 4, 60)], "group string, yr int, pop bigint")
    assert rows(G.index_series(agg, ["group"], "yr", "pop"), "yr", "idx") == [
        (1, 100.0), (2, 150.0), (4, 120.0),
    ]
    assert rows(G.growth_aggregate(agg), "y1", "y2", "growth") == [(1, 2, 0.5), (2, 4, -0.2)]


def brute_pairs(data, mode):
    """The pair table straight from its definition, per group."""
    years = sorted({r[2] for r in data})
    out = set()
    for g in {r[0] for r in data}:
        values = {(u, y): v for gg, u, y, v in data if gg == g}
        own = {y for _, y in values}
        units = {u for u, _ in values}
        for i, y1 in enumerate(years):
            later = [y2 for y2 in years[i + 1:] if y1 in own or y2 in own]
            for y2 in later if mode == "all" else later[:1]:
                for u in units:
                    if (u, y1) in values or (u, y2) in values:
                        out.add((g, u, y1, y2, values.get((u, y1)), values.get((u, y2))))
    return sorted(out, key=repr)


IRREGULAR = [
    ("A", 1, 1, 5), ("A", 2, 1, 2), ("A", 1, 3, 9), ("A", 3, 3, None), ("A", 2, 6, 7),
    ("B", 1, 2, 4), ("B", 4, 2, 0), ("B", 1, 6, None), ("B", 5, 6, 3),
    ("C", 9, 6, 1), (None, 7, 1, 3), (None, 7, 2, 4),
]


@pytest.mark.parametrize("mode", ["all", "consecutive"])
def test_pairs_of_groups_with_gaps(spark, mode):
    """Groups lacking periods follow the definition."""
    p = spark.createDataFrame(IRREGULAR, "group string, unit bigint, yr int, value bigint")
    got = rows(P.pair_values(p, mode), "group", "unit", "y1", "y2", "m1", "m2")
    assert got == brute_pairs(IRREGULAR, mode)


def test_explicit_pairs_and_years(spark):
    p = spark.createDataFrame(IRREGULAR, "group string, unit bigint, yr int, value bigint")
    pairs = spark.createDataFrame([("A", 1, 6), ("B", 2, 6)], "group string, y1 int, y2 int")
    got = rows(P.pair_values(p, pairs=pairs), "group", "unit", "y1", "y2", "m1", "m2")
    assert got == [
        ("A", 1, 1, 6, 5, None), ("A", 2, 1, 6, 2, 7),
        ("B", 1, 2, 6, 4, None), ("B", 4, 2, 6, 0, None), ("B", 5, 2, 6, None, 3),
    ]
    two = rows(P.pair_values(p, "all", years=[1, 3]), "group", "unit", "m1", "m2")
    assert ("A", 1, 5, 9) in two and ("A", 3, None, None) in two


def test_presence_matches_pair_rows(spark):
    p = spark.createDataFrame(IRREGULAR, "group string, unit bigint, yr int, value bigint")
    keys = ["group", "y1", "y2", "m1_missing", "m2_missing"]
    direct = (
        P.pair_values(p, "all")
        .withColumns({"m1_missing": F.col("m1").isNull(), "m2_missing": F.col("m2").isNull()})
        .groupBy(*keys)
        .agg(F.count("*").alias("n"))
    )
    assert rows(P.presence(p), *keys, "n") == rows(direct, *keys, "n")


def test_shares_and_lumping(spark):
    df = spark.createDataFrame(
        [("T", "a"), ("T", "a"), ("T", "b"), ("T", None)], "group string, area string"
    )
    other = F.concat(F.lit("Other ("), F.col("group"), F.lit(")"))
    got = rows(C.lump_rare(df, "area", 2, ["group"], other, "lumped"), "area", "lumped")
    assert sorted(got, key=repr) == sorted(
        [("a", "a"), ("a", "a"), ("b", "Other (T)"), (None, None)], key=repr
    )
    totals = spark.createDataFrame([("x", 1), ("x", 3), ("y", 5)], "k string, v bigint")
    shares = C.share_of_total(totals, "v", ["k"])
    assert rows(shares, "k", "v", "tot", "pct") == [("x", 1, 4, 0.25), ("x", 3, 4, 0.75), ("y", 5, 5, 1.0)]


def test_random_panel_invariants(spark):
    """Parts add up to the total change; shares of a unit's signs add up to one."""
    p = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("group"),
        (F.col("id") % 57).alias("unit"),
        (F.pmod(F.xxhash64("id"), F.lit(6)) + 2000).cast("int").alias("yr"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).alias("value"),
    ).groupBy("group", "unit", "yr").agg(F.max("value").alias("value"))
    parts = G.decompose(P.pair_values(p))
    sums = {(r["group"], r["yr"]): r["pop"] for r in G.period_totals(p).collect()}
    for r in parts.groupBy("group", "y1", "y2").agg(F.sum("dd").alias("d")).collect():
        assert r["d"] == sums.get((r["group"], r["y2"]), 0) - sums.get((r["group"], r["y1"]), 0)
    shares = C.sign_share(P.pair_values(p)).groupBy("unit").agg(F.sum("pct").alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in shares.collect())


def test_overlap_bounds_and_rollup_totals(spark):
    """Jaccard lies in [0, 1]; area changes add up to the changes of the units."""
    from paneldrift.operators.areas import area_changes, area_levels, rank_areas

    p = spark.range(300).select(
        (F.col("id") % 2).cast("string").alias("group"),
        (F.col("id") % 41).alias("unit"),
        (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int").alias("yr"),
        F.nullif(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9)), F.lit(4)).alias("value"),
    ).groupBy("group", "unit", "yr").agg(F.max("value").alias("value"))
    assert all(0 <= r["jaccard"] <= 1 for r in P.jaccard(P.presence(p)).collect())
    areas = spark.range(45).select(F.col("id").alias("unit"), (F.col("id") % 4).cast("string").alias("area"))
    pv = P.pair_values(p)
    changes = area_changes(C.change_class(pv), areas)
    want = C.change_class(pv).agg(F.sum("d_m")).first()[0]
    assert changes.agg(F.sum("d_m")).first()[0] == want
    assert rank_areas(pv, areas).agg(F.sum("tot")).first()[0] == want
    assert changes.where("y1 is null").select("tt", "d_m").distinct().collect() == [(None, None)]
    level = area_levels(pv, areas).agg(F.sum("m1")).first()[0]
    assert level == pv.agg(F.sum("m1")).first()[0]


def test_duplicate_keys_raise(spark):
    twice = [("A", 1, 2000, 5), ("A", 1, 2000, 6), ("A", 1, 2001, 7)]
    p = spark.createDataFrame(twice, "group string, unit bigint, yr int, value bigint")
    for build in (P.pair_values, lambda p: P.pair_values(p, "all"), P.presence):
        with pytest.raises(Exception, match="duplicate panel key"):
            build(p).collect()
