"""Sources, text, dictionaries, profiles, statistics and checks on small inputs."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneldrift.functions import text as T
from paneldrift.functions import values as V
from paneldrift.functions.bins import CHANGE_BREAKS, CHANGE_LABELS, cut
from paneldrift.functions.geometry import polygon_area
from paneldrift.operators import areas as A
from paneldrift.operators import checks as K
from paneldrift.operators import dictionary as D
from paneldrift.operators import stats as M
from paneldrift.operators.profile import profile_wide, row_shares
from paneldrift.sources import panels as SP
from paneldrift.sources import tables as ST

from conftest import rows


def test_text(spark):
    df = spark.createDataFrame(
        [("North Vancouver T", "Waterfront (77)", "1971 Census", "1,234[note 1]", "12.0", "A B  C D")],
        "a string, b string, c string, d string, e string, f string",
    )
    got = df.select(
        T.strip_suffix("a"), T.strip_parenthetical("b"), V.safe_int(T.token("c")), T.plain_number("d"),
        V.safe_int("e"), T.title_token(F.lit("TORONTO CMA")), T.slug("b"), T.first_tokens("c", 3),
        T.first_tokens("f", 3), T.token("c", 5),
    ).first()
    assert list(got) == [
        "North Vancouver", "Waterfront", 1971, 1234, 12, "Toronto", "waterfront_(77)", "1971 Census", "A B", None,
    ]
    ints = spark.createDataFrame([("x",), ("..",), (" 12",), ("12.0",), (None,)], "t string")
    assert [r[0] for r in ints.select(V.safe_int("t")).collect()] == [None, None, 12, 12, None]
    exact = ["9007199254740993", "-9223372036854775808", "9223372036854775808", "12f", "12D", "1e3", "+7", "1.9", ".", "NaN"]
    ints = spark.createDataFrame([(t,) for t in exact], "t string")
    wanted = [9007199254740993, -(2**63), None, None, None, 1000, 7, 1, None, None]
    assert [r[0] for r in ints.select(V.safe_int("t")).collect()] == wanted
    prices = spark.createDataFrame([("9,007,199,254,740,993[note]",), ("5f",)], "t string")
    assert [r[0] for r in prices.select(T.plain_number("t")).collect()] == [9007199254740993, None]


def test_blank_cells_keep_their_places(spark):
    def parsed(values):
        content = f"1971 Census,TORONTO CMA,1,2,3\n{values}"
        files = spark.createDataFrame([("1971", "a.csv", content)], "folder string, file string, content string")
        panel, totals = SP.parse_transposed(files)
        return rows(panel, "unit", "value"), rows(totals, "pop")

    assert parsed(",600,100,200,300") == ([(1, 100), (2, 200), (3, 300)], [(600,)])
    assert parsed('"a, ""b""",600,100,,300') == ([(1, 100), (2, None), (3, 300)], [(600,)])
    assert parsed("x,,100,200,") == ([(1, 100), (2, 200), (3, None)], [(None,)])


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"x ""q"", y",2\nplain,3\n')
    got = ST.read_csv(spark, str(tmp_path / "q.csv"), "a string, b int")
    assert rows(got, "a", "b") == [("plain", 3), ('x "q", y', 2)]
    ST.write_table(got, str(tmp_path / "back"), "csv")
    assert rows(ST.read_csv(spark, str(tmp_path / "back"), "a string, b int")) == rows(got)


def test_profile_with_other_terms(spark, tmp_path):
    line = ",".join(["2016", "7", "", "", "", "", "", "", "Births", "", "", "12", "", ""])
    (tmp_path / "p.csv").write_text(",".join(ST.PROFILE_COLUMNS) + "\n" + line + "\n")
    units = spark.createDataFrame([(7,)], "unit bigint")
    got = ST.read_profile(spark, str(tmp_path / "p.csv"), units, {"Births": "births"})
    assert rows(got, "unit", "births") == [(7, 12)]


def test_cut(spark):
    df = spark.createDataFrame([(v,) for v in (-12000, 0, 5000, 5001, 70000)], "v int")
    got = [r[0] for r in df.select(cut("v", CHANGE_BREAKS, CHANGE_LABELS)).collect()]
    assert got == [None, "<0", "0-5K", ">5K", None]


def test_weighted_mean(spark):
    schema = "k string, x bigint, w bigint"
    full = spark.createDataFrame([("a", 10, 1), ("a", None, 5), ("a", 30, 3)], schema)
    holey = spark.createDataFrame([("a", 10, 1), ("a", None, 5), ("a", 30, None)], schema)
    assert M.weighted_means(full, ["k"], ["x"], "w").first()["x"] == 25.0
    assert M.weighted_means(holey, ["k"], ["x"], "w").first()["x"] is None


def test_quantiles(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 7, 10)] + [("b", 5), ("b", None)], "k string, v int")
    assert rows(M.quartiles(df, ["k"], "v"), "k", "q1", "q3", "iqr") == [
        ("a", 2.25, 6.25, 4.0), ("b", 5.0, 5.0, 0.0),
    ]
    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(0, 40, 500)]
    big = spark.createDataFrame([("z", v) for v in values], "k string, v int")
    got = M.quantiles(big, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.99, "d": 1.0}).first()
    assert list(got)[1:] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99, 1.0])))
    box = M.boxplot(spark.createDataFrame([("a", v) for v in (1, 2, 3, 4, 5, 30)], "k string, v int"), ["k"], "v")
    assert rows(box, "whisker_low", "whisker_high", "n_outliers") == [(1, 5, 1)]


def test_histogram_ends(spark):
    df = spark.createDataFrame([(float(v),) for v in range(16)], "v double")
    got = {r["bin"]: r["n"] for r in M.histogram(df, [], F.col("v"), 15).collect()}
    assert got[15] == 2 and sum(got.values()) == 16
    flat = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert rows(M.histogram(flat, [], F.col("v"), 15)) == [(1, 2)]


def test_regression_against_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    y = 2 + x @ np.array([1.0, -2, 0.5, 0.1, 0, 3]) + rng.normal(size=80)
    names = ["area", "income", "singd", "semd", "row", "apt"]
    df = spark.createDataFrame(
        [(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"`{n}` double" for n in names) + ", y double"
    )
    model = M.growth_regression(df, "y")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    design = np.column_stack([np.ones(80), z[:, 0], z[:, 1], z[:, 2] + z[:, 3], z[:, 4] + z[:, 5]])
    beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    table = {r["term"]: r for r in M.ols_table(model, M.MODEL_TERMS, df).collect()}
    terms = ["(Intercept)", *M.MODEL_TERMS]
    assert [table[t]["estimate"] for t in terms] == pytest.approx(list(beta))
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 75)
    assert [table[t]["std_error"] for t in terms] == pytest.approx(list(errors))
    assert table["area"]["ci_high"] - table["area"]["estimate"] == pytest.approx(1.992102 * errors[1], rel=1e-5)
    r2 = 1 - rss[0] / ((y - y.mean()) ** 2).sum()
    assert table["area"]["r2"] == pytest.approx(r2) and table["area"]["n"] == 80
    assert table["area"]["r2_adj"] == pytest.approx(1 - (1 - r2) * 79 / 75)


def test_simple_regression_and_zscore(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(10)], "k string, x double, y double")
    fit = M.regr_by(df, "k", "y", "x").first()
    assert (fit["slope"], fit["intercept"], fit["n"]) == (pytest.approx(2), pytest.approx(1), 10)
    assert fit["resid_error"] == pytest.approx(0, abs=1e-6)
    z = [r["x"] for r in M.zscore(df, ["x"]).collect()]
    assert np.mean(z) == pytest.approx(0) and np.std(z, ddof=1) == pytest.approx(1)


def test_mode_and_dictionary(spark):
    df = spark.createDataFrame(
        [(1, "b", "y"), (1, "b", "y"), (1, "a", "x"), (1, "a", "x"), (2, None, "z"), (2, "q", "z")],
        "unit int, c1 string, c2 string",
    )
    assert rows(D.most_common(df, "unit", ["c1", "c2"])) == [(1, "a", "x", 2), (2, "q", "z", 1)]

    dictionary = spark.createDataFrame(
        [(1, "T", "Core 1", "c", "d"), (2, "T", "Core", "c", "d"), (3, "T", "Side", "c", "d"), (9, "T", "X", "c", "d")],
        "unit bigint, cma string, csd string, ccsd string, cd string",
    )
    bridge = spark.createDataFrame(
        [("1", "Core", "P1", 1.0, 2.0), ("1", "Core", "P2", 1.0, 3.0), ("2", "Core", None, None, None),
         ("3", "Side", "P1", 0.0, 0.0), ("x9", "Core", "P1", 0.0, 0.0)],
        "unit string, csd string, postcode string, lat double, lon double",
    )
    cities = spark.createDataFrame([("P1", "North"), (None, "Unknown")], "postcode string, city string")
    units = spark.createDataFrame([(1,), (2,), (3,)], "unit bigint")
    got = D.build_dictionary(dictionary, bridge, cities, units, "Core", min_count=0)
    assert rows(got, "unit", "csd", "postcode", "csd_alt") == [
        (1, "Core", "P1", "North"), (1, "Core", "P2", "Core"), (2, "Core", None, "Unknown"), (3, "Side", "P1", "Side"),
    ]
    fewer = D.build_dictionary(dictionary, bridge, cities, units, "Core", min_count=1)
    assert {r["csd_alt"] for r in fewer.where("csd = 'Core'").collect()} == {"Core"}


def test_profile(spark):
    long = spark.createDataFrame(
        [(1, "Row house", "4"), (1, "Apartment or flat in a duplex", "2"), (1, "other", "9"),
         (1, "Apartment in a building that has five or more storeys", "1"),
         (1, "Apartment in a building that has fewer than five storeys", "5"),
         (2, "Row house", "x"), (2, "Apartment or flat in a duplex", "2"), (3, "Row house", "7")],
        "unit bigint, term string, value string",
    )
    units = spark.createDataFrame([(1,), (2,)], "unit bigint")
    wide = profile_wide(long, ST.PROFILE_TERMS, units, ST.PROFILE_SUMS)
    assert rows(wide, "unit", "row", "apt") == [(1, 4, 8), (2, None, None)]
    shares = row_shares(spark.createDataFrame([(1, 3, 1), (2, 0, 0)], "id int, a int, b int"), ["a", "b"])
    assert rows(shares, "id", "a", "b") == [(1, 0.75, 0.25), (2, None, None)]


def test_rollup_and_enrichment(spark):
    changes = spark.createDataFrame(
        [("Net Density", "n1", 10), ("Net DAs", "n1", 4000), ("Net DAs", "n2", -5), ("Net DAs", "n3", None)],
        "tt string, area string, d_m bigint",
    )
    dictionary = spark.createDataFrame(
        [("n1", "Zed"), ("n1", "Toronto"), ("n2", "Zed"), ("n3", None)], "area string, parent string"
    )
    rolled = A.rollup_area(changes, dictionary, rename={"Toronto": "Old Toronto"})
    assert rows(rolled, "area", "d_m", "parent", "gg") == [
        ("n1", 4010, "Old Toronto", "0-5K"), ("n2", -5, "Zed", "<0"), ("n3", None, None, None),
    ]
    assert rows(A.enrichment(rolled, "parent"), "parent", "neg", "pos", "pct") == [
        ("Old Toronto", 0, 1, 0.0), ("Zed", 1, 0, 1.0), (None, 0, 0, None),
    ]


def test_transposed_files(spark, tmp_path):
    files = {
        "1971 data/a.csv": "1971 Census,TORONTO CMA,35200001,35200002\nPopulation,900,400,\n",
        "1971 data/a_v2.csv": '"1971 Census, all",35200003,35200004\n"Population, total",50,"7"\nignored,1,2\n',
        "1981 data/b.csv": "1981 Census,VANCOUVER CMA,5900001\r\nPopulation,5,4\r\n",
        "notes/c.csv": "x,y\n1,2\n",
    }
    for name, content in files.items():
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(content.encode())
    panel, totals = SP.read_transposed_panel(spark, str(tmp_path))
    assert rows(totals, "yr", "group", "pop") == [(1971, "Toronto", 900), (1981, "Vancouver", 5)]
    assert rows(panel, "group", "unit", "yr", "value") == [
        ("Toronto", 35200001, 1971, 400), ("Toronto", 35200002, 1971, None),
        ("Toronto", 35200003, 1971, 50), ("Toronto", 35200004, 1971, 7),
        ("Vancouver", 5900001, 1981, 4),
    ]
    assert SP.checked_panel(panel).count() == 5
    with pytest.raises(K.CheckFailed):
        SP.checked_panel(panel.union(panel))


def test_wide_lines_are_read_in_ranges(spark, tmp_path):
    """A line of 100,000 units spreads over tasks; quoted commas and line breaks may lie at any range's edge."""
    n = 100_000
    rnd = random.Random(3)
    heads = [f'"{i}"' if rnd.random() < 0.3 else str(i) for i in range(n)]
    values = [rnd.choice(["", "7", '"1,200"', '" 5 "', "x", '"a ""b"", c"']) for _ in range(n)]
    folder = tmp_path / "1991 data"
    folder.mkdir()
    title = '"1991 Census, revised",TORONTO CMA,'
    (folder / "a.csv").write_text(title + ",".join(heads) + '\r\n"Population, all",12,' + ",".join(values) + "\r\n")
    (folder / "a_v2.csv").write_text("1991 Census,200001,200002\n,3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        cells = SP.file_cells(spark, str(tmp_path))
        scan = spark.read.option("lineSep", ",").text(f"{tmp_path}/*/*.csv")
        assert scan.rdd.getNumPartitions() > 10
        panel, totals = SP.parse_cells(cells)
        got = {r["unit"]: r["value"] for r in panel.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = {"": None, "7": 7, '"1,200"': None, '" 5 "': 5, "x": None, '"a ""b"", c"': None}
    assert got == {i: whole[v] for i, v in enumerate(values)} | {200001: 3, 200002: None}
    assert rows(totals, "yr", "group", "pop") == [(1991, "Toronto", 12)]
    plain = SP.parse_transposed(SP.year_files(spark, str(tmp_path)))[0]
    assert plain.exceptAll(panel).count() == 0 and panel.exceptAll(plain).count() == 0


def test_layouts_of_panel_folders(spark, tmp_path):
    content = "1971 Census,TORONTO CMA,1,2\nPopulation,9,4,5"
    frame = spark.createDataFrame([("1971 data", "t 1.csv", content), ("notes", "x.csv", "1,2")], "folder string, file string, content string")
    frame.write.partitionBy("folder", "file").text(f"{tmp_path}/p")
    panel, _ = SP.read_transposed_panel(spark, f"{tmp_path}/p", "partitions")
    assert rows(panel, "group", "unit", "yr", "value") == [("Toronto", 1, 1971, 4), ("Toronto", 2, 1971, 5)]
    with pytest.raises(ValueError):
        SP.file_cells(spark, str(tmp_path), "other")


def test_long_file(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "Geo,Pop,Extra\nTORONTO CMA (x),10,1\n35200001 (00000),7,1\n59000001 (00010),..,1\n"
    )
    panel, totals = SP.read_long_panel(spark, str(tmp_path / "p.csv"), 2016, {"35": "Toronto"}, "Vancouver")
    assert rows(panel, "group", "unit", "yr", "value") == [
        ("Toronto", 35200001, 2016, 7), ("Vancouver", 59000001, 2016, None),
    ]
    assert rows(totals, "group", "yr", "pop") == [("Toronto", 2016, 10)]


def test_tables_and_sinks(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        '"DAUID,C,8","PRNAME,C,100","CSDNAME,C,100","CCSNAME,C,100","CDNAME,C,100","CMANAME,C,100"\n1,ON,a,b,c,d\n'
    )
    assert rows(ST.read_dictionary(spark, str(tmp_path / "d.csv"))) == [(1, "d", "a", "b", "c")]
    head = ",".join(f"c{i}" for i in range(14))
    line = "2016,35,,,,,,,Row house,,,12,,\n2016,35,,,,,,,Other,,,99,,\n2016,36,,,,,,,Row house,,,1,,\n"
    (tmp_path / "p.csv").write_text(head + "\n" + line)
    units = spark.createDataFrame([(35,)], "unit bigint")
    profile = ST.read_profile(spark, str(tmp_path / "p.csv"), units)
    assert rows(profile, "year", "unit", "row", "pop") == [(2016, 35, 12, None)]
    df = spark.createDataFrame([(1, 2001), (2, 2002)], "unit int, yr int")
    ST.write_table(df, str(tmp_path / "out"), partition_by=["yr"])
    ST.write_table(df, str(tmp_path / "csv"), fmt="csv")
    assert rows(spark.read.parquet(str(tmp_path / "out")), "unit", "yr") == [(1, 2001), (2, 2002)]
    assert rows(ST.read_csv(spark, str(tmp_path / "csv"), "unit int, yr int", ["yr"])) == [(2001,), (2002,)]


def test_polygon_files(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    far = [[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]
    features = [
        {"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": {"name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [far]]}},
        {"type": "Feature", "properties": {"name": "c"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "l.json").write_text("\n".join(json.dumps(f) for f in features))
    layer = ST.read_polygons(spark, str(tmp_path / "l.json"), "geojson")
    sized = layer.select(F.col("properties")["name"].alias("name"), polygon_area("rings").alias("area"))
    assert rows(sized) == [("a", 4.0), ("b", 5.0)]
    ST.write_polygons(layer, str(tmp_path / "layer"))
    assert ST.read_polygons(spark, str(tmp_path / "layer")).count() == 2


def test_checks_find_planted_violations(spark):
    df = spark.createDataFrame(
        [("T", 1, 1), ("T", 1, 1), ("T", 1, 2), ("T", 2, 9)], "group string, yr int, unit bigint"
    )
    assert rows(K.duplicate_keys(df, ["group", "yr", "unit"]), "unit", "n") == [(1, 2)]
    known = spark.createDataFrame([(1,), (2,)], "unit bigint")
    assert rows(K.unknown_keys(df, known, ["unit"])) == [(9,)]
    long = spark.createDataFrame(
        [(g, t) for g in (1, 2, 3) for t in "abc" if (g, t) != (3, "c")], "geo int, term string"
    )
    assert rows(K.block_sizes(long, "geo")) == [(3, 2, 3)]
    assert rows(K.block_sizes(long, "geo", 2), "geo") == [(1,), (2,)]
    assert K.repeated_terms(long, "geo", "term").count() == 0
    assert rows(K.row_count_gap(df, known, "unit")) == [(4, 2)]
    assert K.row_count_gap(known, known, "unit").count() == 0
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, x string")
    right = spark.createDataFrame([(1, "a"), (2, "c"), (3, "z")], "k int, y string")
    assert rows(K.disagreements(left, right, ["k"], "x", "y")) == [(2, "b", "c")]
    v1 = spark.createDataFrame([(1, 5), (2, 7), (3, 1)], "k int, v int")
    v2 = spark.createDataFrame([(1, 5), (2, 4)], "k int, v int")
    assert rows(K.version_differences(v1, v2, ["k"], "v")) == sorted([(0, 1), (3, 1), (None, 1)], key=repr)
    assert K.unassigned(spark.createDataFrame([("",), ("a",), (None,)], "area string"), "area").count() == 2
