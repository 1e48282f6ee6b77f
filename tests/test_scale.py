"""Hot keys, large groups and distributed order against plain Python."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from paneldrift.operators import reshape as R
from paneldrift.operators import scale as S

from conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows under one key, copies among them, and NULL keys."""
    data = [("hot", i % 7) for i in range(500)] + [(f"k{i % 40}", i) for i in range(400)]
    data += [(None, i) for i in range(100)]
    return spark.createDataFrame(data, "k string, v int")


def counted(df, key="k"):
    return df.groupBy(key).agg(F.count("*").alias("n"))


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_skew_join_equals_plain_join(spark, hot, limit):
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k3", 3), (None, 4), ("other", 5)], "k string, w int"
    )
    plain = S.join_on(hot, right, ["k"])
    salted = S.skew_join(hot, right, ["k"], counted(hot), counted(right), limit)
    assert rows(salted, "k", "v", "w") == rows(plain, "k", "v", "w")
    turned = S.skew_join(right, hot, ["k"], counted(right), counted(hot), limit)
    assert rows(turned, "k", "v", "w") == rows(plain, "k", "v", "w")


def spread_of(joined):
    """Rows of the largest salted group and how many groups there are."""
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    return "_sl" in text


def test_keys_above_the_rows_of_a_task_are_split(spark):
    right = spark.range(80).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    even = spark.range(7000).select((F.col("id") % 70).alias("k"), "id")
    assert spread_of(S.skew_join(even, right, ["k"], counted(even), counted(right), 50))
    assert not spread_of(S.skew_join(even, right, ["k"], counted(even), counted(right), 100))
    one = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    assert spread_of(S.skew_join(one, right, ["k"], counted(one), counted(right), 100))
    other = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("w"))
    crowded = S.skew_join(right.select("k"), other, ["k"], counted(right), counted(other), 100)
    assert spread_of(crowded) and crowded.count() == 1000


def test_left_join_many_keeps_unmatched(spark, hot):
    dim = spark.createDataFrame([("hot", "x"), ("gone", "y"), (None, "z")], "k string, name string")
    got = S.left_join_many(dim, hot, ["k"])
    plain = S.join_on(dim, hot, ["k"], "left")
    assert rows(got, "k", "name", "v") == rows(plain, "k", "name", "v")


def test_running_totals_and_numbers(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("x"),
        "id",
    )
    data = sorted(((r["g"], r["x"], r["id"]) for r in df.collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    want, seen, total = [], Counter(), Counter()
    for g, x, i in data:
        seen[g] += 1
        total[g] += x
        want.append((g, i, seen[g], total[g]))
    order = [F.col("x").asc(), F.col("id").asc()]
    got = S.running_totals(df, ["g"], order, {"rn": F.lit(1).cast("bigint"), "t": F.col("x")})
    assert rows(got, "g", "id", "rn", "t") == sorted(want, key=repr)
    fractions = R.rank_fraction(df, ["g"], order)
    assert {r["fraction"] for r in fractions.where("g = 'mid'").collect()} == {
        (i + 1) / 200 for i in range(200)
    }
    no_group = S.numbered(df, [], [F.col("id").desc()])
    assert {(r["id"], r["rn"]) for r in no_group.collect()} == {(i, 1000 - i) for i in range(1000)}


def test_carry_forward(spark):
    data = [(i, None if i % 5 else f"c{i}") for i in range(1, 60)]
    df = spark.createDataFrame(data, "i int, c string")
    want, last = [], None
    for i, c in data:
        last = c or last
        want.append((i, last))
    got = S.carry_forward(df, "c", [F.col("i").asc()])
    assert [(r["i"], r["c"]) for r in got.orderBy("i").collect()] == want


def test_ordered_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("a", 9), ("b", 2)], "k string, x int")
    got = S.ordered_gaps(df, ["k"], [F.col("x").asc()], "x")
    assert rows(got, "k", "x", "rn", "gap") == [
        ("a", 1, 1, None), ("a", 4, 2, 3), ("a", 9, 3, 5), ("b", 2, 1, None),
    ]


def test_gaps_across_slices(spark):
    df = spark.range(500).select((F.col("id") * F.col("id")).alias("x"), F.lit("one").alias("k"))
    got = S.ordered_gaps(df.repartition(7), ["k"], [F.col("x").asc()], "x").orderBy("rn").collect()
    assert [r["rn"] for r in got] == list(range(1, 501))
    assert [r["gap"] for r in got] == [None, *[2 * i - 1 for i in range(1, 500)]]


def test_top_k_sample_and_order(spark):
    df = spark.createDataFrame(
        [("x", "a", 5), ("x", "b", 9), ("x", "c", -1), ("x", "d", -7), ("x", "e", 0), ("x", "f", 9)],
        "tt string, name string, d int",
    )
    top = R.top_k_signed(df, "d", 2, ["tt"], "name")
    assert rows(top, "sign", "rank", "name") == [
        ("Gain", 1, "b"), ("Gain", 2, "f"), ("Loss", 1, "d"), ("Loss", 2, "c"),
    ]
    shared = spark.createDataFrame([("g", "a", 60), ("h", "a", 60), ("g", "b", 100)], "g string, c string, d int")
    assert [r["c"] for r in R.category_order(shared, "c", "d", within=["g"]).orderBy("ord").collect()] == ["b", "a"]
    ordered = R.category_order(df, "name", "d")
    assert [r["name"] for r in ordered.orderBy("ord").collect()] == ["b", "f", "a", "e", "c", "d"]
    units = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    one, two = (rows(R.hash_sample(units, "id", 5, ["g"], 3)) for _ in range(2))
    assert one == two and len(one) == 10
    assert one != rows(R.hash_sample(units, "id", 5, ["g"], 4))


def test_set_operations_and_reshape(spark):
    a = spark.createDataFrame([(1, "p", 2), (1, "q", 3), (2, "p", None)], "id int, label string, v int")
    wide = R.pivot_values(a, ["id"], "label", "v", ["p", "q", "r"])
    assert rows(wide, "id", "p", "q", "r") == [(1, 2, 3, None), (2, None, None, None)]
    b = spark.createDataFrame([(2,), (3,)], "id int")
    assert rows(R.except_keys(a, b, ["id"])) == [(1,)]
    stacked = R.union_tagged({"a": a, "b": b})
    assert stacked.columns == ["id", "label", "v", "tt"] and stacked.count() == 5
    net = spark.createDataFrame([("x", 1, 2, 9), ("x", 3, None, 9)], "k string, `Net A` int, `Net B` int, other int")
    assert R.columns_matching(net, "^Net") == ["Net A", "Net B"]
    assert rows(R.sum_matching(net, ["k"], "^Net")) == [("x", 4, None)]
    text = R.collect_string(a.where("v is not null"), ["id"], "v", "text")
    assert rows(text, "id", "text") == [(1, "2, 3")]


def test_no_python_workers_or_unbounded_windows(spark):
    """Query plans stay in the JVM and none has a window without partition keys."""
    from paneldrift.plans import QUERIES

    for name in ("growth_decompose", "jaccard_pairs", "cohort_index", "change_class_area", "topk_gain_loss"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan
