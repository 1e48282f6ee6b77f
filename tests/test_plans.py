"""Physical plans: how often the panel is shuffled and what reaches the scan."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from paneldrift.operators import classes as C
from paneldrift.operators import growth as G
from paneldrift.operators import pairs as P
from paneldrift.operators import reshape as R
from paneldrift.operators.scale import join_on, skew_join


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A panel and a dictionary on disk."""
    folder = str(tmp_path_factory.mktemp("stored"))
    spark.range(5000).select(
        F.concat(F.lit("g"), F.col("id") % 3).alias("group"),
        (F.col("id") % 700).alias("unit"),
        (F.col("id") % 7 + 2000).cast("int").alias("yr"),
        (F.col("id") % 11).alias("value"),
        F.lit("never read").alias("note"),
    ).dropDuplicates(["group", "unit", "yr"]).write.parquet(f"{folder}/panel")
    spark.range(30000).select(
        F.col("id").alias("unit"), F.concat(F.lit("a"), F.col("id") % 9).alias("area")
    ).write.parquet(f"{folder}/dictionary")
    return spark.read.parquet(f"{folder}/panel"), spark.read.parquet(f"{folder}/dictionary")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df, key: str) -> int:
    """Exchanges whose partitioning starts with the key column."""
    return len(re.findall(rf"Exchange hashpartitioning\({key}#", plan(df)))


def unit_shuffles(df) -> int:
    """Exchanges that move panel rows: partitioned by unit, alone or with the group."""
    return len(re.findall(r"Exchange hashpartitioning\((?:group#\d+, )?unit#", plan(df)))


@pytest.mark.parametrize("mode", ["consecutive", "all"])
def test_pairs_shuffle_the_panel_once(stored, mode):
    pv = P.pair_values(stored[0], mode)
    assert unit_shuffles(pv) == 1
    assert "SortMergeJoin" not in plan(pv)


def test_decomposition_adds_one_aggregation(stored):
    parts = G.decompose(P.pair_values(stored[0]))
    assert unit_shuffles(parts) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(group#\d+, y1#\d+, y2#\d+, \d+\)", plan(parts))) == 1
    assert plan(parts).count("Window ") == 1


def test_presence_and_cohorts_shuffle_the_panel_once(stored):
    assert unit_shuffles(P.presence(stored[0])) == 1
    assert unit_shuffles(G.cohort_index(stored[0], years=list(range(2000, 2007)))) == 1
    assert unit_shuffles(G.period_delta(stored[0], years=list(range(2000, 2007)))) == 1


def test_scans_read_only_needed_columns(stored):
    text = plan(G.decompose(P.pair_values(stored[0])))
    assert "note" not in text
    two = plan(P.pair_values(stored[0], "all", years=[2001, 2004]))
    assert "In(yr, [2001,2004])" in two


def test_dictionary_join_reuses_the_unit_partitioning(spark, stored):
    """With broadcasts of the period roles only: one shuffle of the panel, one of the dictionary."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
    try:
        pv = P.pair_values(stored[0], by_unit_only=True)
        joined = join_on(C.change_class(pv), stored[1], ["unit"], "left", null_safe=False)
        assert shuffles(joined, "unit") + shuffles(joined, "_r_unit") == 2
        assert unit_shuffles(joined) == 1
        assert "SortMergeJoin" in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_k_limits_before_the_shuffle(stored):
    top = R.top_k_signed(stored[0], "value", 3, ["group"], "unit")
    text = plan(top)
    assert text.count("WindowGroupLimit") == 2


def test_totals_do_not_use_a_window(stored):
    shares = C.share_of_total(stored[0], "value", ["group"])
    assert "Window" not in plan(shares)


def test_no_salting_without_hot_keys(stored):
    counts = [df.groupBy("unit").agg(F.count("*").alias("n")) for df in stored]
    joined = skew_join(stored[0], stored[1], ["unit"], *counts)
    assert "_sl" not in plan(joined)


def test_gain_loss_is_one_expanded_aggregation(stored):
    text = plan(C.gain_loss(P.pair_values(stored[0])))
    assert text.count("Expand") == 1
