"""Broken profile rows, GeoJSON both ways, columns from labels of the data, stacked series."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from paneldrift.functions import geometry as Y
from paneldrift.operators import areas as A
from paneldrift.operators import classes as C
from paneldrift.operators import growth as G
from paneldrift.operators import reshape as R
from paneldrift.sources import tables as ST

from conftest import rows

HEADER = ",".join(f"h{i}" for i in range(14))


def line(unit, term, value, year="2016"):
    return f'{year},{unit},1,2,a,b,0,c,"{term}",9,n,{value},3,4'


def test_profile_with_broken_rows(spark, tmp_path):
    good = [line(1, "Births", 5), line(2, "Births", ".."), line(1, "Deaths, all", 7), line(3, "Births", 1)]
    broken = ["2016,1,2", "2016,2,1,2,a,b,0,c,Births,9,n,3,3,4,5,6", line("x", "Births", 1), line(4, "Births", 1, "MMXVI"), ""]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *good[:2], *broken[:3]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([HEADER, *broken[3:], *good[2:]]) + "\n")
    units = spark.createDataFrame([(1,), (2,), (4,)], "unit bigint")
    terms = {"Births": "births", "Deaths, all": "deaths"}
    kept, bad = ST.read_checked_profile(spark, str(tmp_path), units, terms)
    assert rows(kept, "year", "unit", "births", "deaths") == [(2016, 1, 5, 7), (2016, 2, None, None)]
    assert sorted((r["reason"], r["record"]) for r in bad.collect()) == sorted([
        ("cells", broken[0]), ("cells", broken[1]), ("unit", "2016,x"), ("year", "MMXVI,4"),
    ])
    # the quick reader takes what it finds: the row with too many cells too
    plain = ST.read_profile(spark, str(tmp_path), units, terms)
    assert rows(plain, "year", "unit", "births", "deaths") == [(2016, 1, 5, 7), (2016, 2, 3, None), (None, 4, 1, None)]


def test_terms_are_filtered_by_the_parser(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, line(1, "Births", 5)]) + "\n")
    ST.read_profile(spark, str(tmp_path), spark.createDataFrame([(1,)], "unit bigint"), {"Births": "births"}).explain("formatted")
    scan = next(p for p in capsys.readouterr().out.split("\n\n") if "Scan csv" in p and "tt" in p)
    assert "PushedFilters" in scan and "EqualTo(tt,Births)" in scan and "male" not in scan


def square(x, y, s, clockwise=False):
    ring = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    return [(float(a), float(b)) for a, b in (reversed(ring) if clockwise else ring)]


def test_geojson_nests_rings(spark, tmp_path):
    shapes = [
        (1, "one", [square(0, 0, 1, True)]),
        (2, 'a "hole", an island', [square(3, 3, 1), square(0, 0, 10), square(2, 2, 5), square(20, 0, 2), [*square(0, 40, 4), (0.0, 40.0)], square(1, 41, 1)]),
        (3, None, []),
    ]
    layer = spark.createDataFrame(shapes, f"id int, name string, rings {Y.RINGS_TYPE}")
    ST.write_geojson(layer, f"{tmp_path}/l")
    features = {f["properties"]["id"]: f for f in (json.loads(r[0]) for r in spark.read.text(f"{tmp_path}/l").collect())}
    assert features[1]["geometry"]["type"] == "Polygon" and features[2]["geometry"]["type"] == "MultiPolygon"
    parts = features[2]["geometry"]["coordinates"]
    assert sorted((len(p), min(p[0])[0]) for p in parts) == [(1, 3.0), (1, 20.0), (2, 0.0), (2, 0.0)]
    assert features[3]["geometry"] == {"type": "MultiPolygon", "coordinates": []}

    def turn(ring):
        return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))

    for f in features.values():
        polygons = [f["geometry"]["coordinates"]] if f["geometry"]["type"] == "Polygon" else f["geometry"]["coordinates"]
        for outer, *holes in polygons:
            assert turn(outer) > 0 and all(turn(h) < 0 for h in holes)
            assert all(r[0] == r[-1] for r in (outer, *holes))
    back = ST.read_polygons(spark, f"{tmp_path}/l", "geojson")
    got = {r["id"]: (r["name"], r["n"], r["area"]) for r in back.select("properties.id", "properties.name", F.size("rings").alias("n"), Y.polygon_area("rings").alias("area")).collect()}
    assert got["1"] == ("one", 1, 1.0) and got["2"] == ('a "hole", an island', 6, 100 - 25 + 1 + 4 + 16 - 1)


def test_columns_from_labels(spark):
    frame = spark.createDataFrame([("p", "Net a", 1), ("p", "b", 2), ("q", "Net c", 3), ("q", None, 4)], "k string, label string, v int")
    wide = R.pivot_found(frame, ["k"], "label", "v")
    assert wide.columns == ["k", "Net a", "Net c", "b"]
    assert rows(wide) == [("p", 1, None, 2), ("q", None, 3, None)]
    assert R.select_matching(wide, ["k"], "^Net").columns == ["k", "Net a", "Net c"]
    assert rows(R.sum_matching(wide.fillna(0), [], "^Net"), "Net a", "Net c") == [(1, 3)]
    with pytest.raises(ValueError):
        R.pivot_found(frame, ["k"], "label", "v", most=2)
    assert R.pivot_found(frame.limit(0), ["k"], "label", "v").columns == ["k"]


def test_stacked_series(spark):
    one = spark.createDataFrame([("a", 1, 2000), ("a", 2, 3000)], "group string, yr int, pop bigint")
    two = spark.createDataFrame([("w", 1, 50), ("w", 2, 25)], "group string, yr int, pop bigint")
    got = rows(G.stacked_index({"own": one, "world": two}, index_only=["world"], scale=1000.0), "tt", "yr", "measure", "value")
    assert got == [
        ("own", 1, "idx", 100.0), ("own", 1, "pop", 2.0), ("own", 2, "idx", 150.0), ("own", 2, "pop", 3.0),
        ("world", 1, "idx", 100.0), ("world", 2, "idx", 50.0),
    ]
    text = spark.createDataFrame([("2001", "1,234[2]", "x"), ("?", "n/a", "y")], "year string, city string, cma string")
    assert rows(R.stack_external({"T": text}, "city")) == [("T", 2001, 1234), ("T", None, None)]


def test_area_cube_gives_what_its_parts_give(spark):
    pairs = [("g", u, y, y + 1, m1, m2) for u, y, m1, m2 in [(1, 1, 5, 9), (1, 2, 9, None), (2, 1, None, 4), (3, 1, 7, 2), (9, 1, 1, 1)]]
    pv = spark.createDataFrame(pairs, "group string, unit bigint, y1 int, y2 int, m1 bigint, m2 bigint")
    units = [(1, "n", "p"), (2, "n", "o"), (3, "m", "p"), (4, "m", "p"), (5, "z", None)]
    dictionary = spark.createDataFrame(units, "unit bigint, area string, parent string")
    classified = C.change_class(pv)
    cube = A.area_cube(classified, dictionary, parent="parent")
    assert rows(A.cube_levels(cube)) == rows(A.area_levels(pv, dictionary))
    assert rows(A.cube_changes(cube), "y1", "tt", "area", "d_m") == rows(A.area_changes(classified, dictionary), "y1", "tt", "area", "d_m")
    want = A.rollup_area(A.area_changes(classified, dictionary), dictionary)
    assert rows(A.cube_rollup(cube), "area", "d_m", "parent", "gg") == rows(want, "area", "d_m", "parent", "gg")
