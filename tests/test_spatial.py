"""Polygon fixtures and random shapes against a plain Python test."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from paneldrift.functions import geometry as Y
from paneldrift.operators import spatial as X

from conftest import rows

LAYER = f"id int, name string, ord int, rings {Y.RINGS_TYPE}"


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def layer(spark, shapes):
    return spark.createDataFrame(
        [(i, f"n{i}", i, [[(float(a), float(b)) for a, b in ring] for ring in rings]) for i, rings in shapes],
        LAYER,
    )


@pytest.fixture(scope="module")
def a(spark):
    return layer(spark, [(1, [box(0, 0, 2, 2)]), (2, [box(2, 0, 2, 2)]), (3, [box(9, 9, 1, 1)])])


@pytest.fixture(scope="module")
def b(spark):
    return layer(
        spark,
        [(10, [box(1, 1, 2, 0.5)]), (11, [box(0.5, 0.5, 0.2, 0.2)]), (12, [box(5, 5, 1, 1)]), (13, [box(4, 0, 1, 1)])],
    )


def test_areas(spark, a):
    assert rows(a.select("id", Y.polygon_area("rings"))) == [(1, 4.0), (2, 4.0), (3, 1.0)]
    holed = layer(spark, [(1, [box(0, 0, 4, 4), box(1, 1, 2, 2)]), (2, [box(0, 0, 1, 1), box(5, 5, 2, 2)])])
    assert rows(holed.select("id", Y.polygon_area("rings"))) == [(1, 12.0), (2, 5.0)]
    assert rows(holed.select("id", Y.polygon_centroid("rings")["x"].alias("x"))) == [
        (1, 2.0), (2, round((0.5 + 4 * 6) / 5, 6)),
    ]
    cell = layer(spark, [(1, [box(0, 0, 1, 1)])])
    km2 = cell.select(Y.polygon_area("rings", "spherical")).first()[0]
    assert km2 == pytest.approx(12363.72, rel=1e-4)
    open_ring = layer(spark, [(1, [box(0, 0, 3, 2)[:-1]])])
    assert rows(open_ring.select(Y.polygon_area("rings"))) == [(6.0,)]


@pytest.mark.parametrize("tile", [0.7, 3.0, 100.0, None])
def test_intersections(a, b, tile):
    got = rows(X.spatial_join(a, b, tile), "a_id", "b_id")
    assert got == [(1, 10), (1, 11), (2, 10), (2, 13)]


def test_last_area_wins(a, b):
    got = rows(X.assign_area(b, a, tile=2.0), "id", "area")
    assert got == [(10, "n2"), (11, "n1"), (12, ""), (13, "n2")]


def test_polygon_in_hole_does_not_intersect(spark):
    ring = layer(spark, [(1, [box(0, 0, 4, 4), box(1, 1, 2, 2)])])
    inside = layer(spark, [(2, [box(1.5, 1.5, 1, 1)]), (3, [box(0.2, 0.2, 0.5, 0.5)]), (4, [box(1, 1, 0.5, 0.5)])])
    assert rows(X.spatial_join(ring, inside, 2.0), "b_id") == [(3,), (4,)]


def test_dissolve(a):
    edges = X.dissolve(a.where("id < 3").withColumn("k", F.lit("x")), ["k"])
    assert edges.count() == 6
    assert edges.where("x1 = 2 and x2 = 2").count() == 0


def test_extent_points_and_layer(spark, a):
    assert rows(X.layer_bbox(a)) == [(0.0, 0.0, 10.0, 10.0)]
    p = X.points(spark.createDataFrame([(1, 2.5, 3.5)], "id int, lon double, lat double"), "lon", "lat")
    assert p.first()["point"].x == 2.5 and p.first()["crs"] == "EPSG:4269"
    keep = spark.createDataFrame([("n1",), ("n3",)], "name string")
    kept = X.prepare_layer(a, keep, "name", drop=["ord"], recode=("name", F.upper("name")))
    assert rows(kept, "id", "name") == [(1, "N1"), (3, "N3")] and "ord" not in kept.columns


def star(rnd, cx, cy, size, corners):
    angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(corners))
    return [
        (cx + size * rnd.uniform(0.4, 1) * math.cos(t), cy + size * rnd.uniform(0.4, 1) * math.sin(t))
        for t in angles
    ]


def segments(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def turn(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def cross(s, t):
    (p, q), (u, v) = s, t
    return turn(p, q, u) * turn(p, q, v) <= 0 and turn(u, v, p) * turn(u, v, q) <= 0


def holds(ring, p):
    inside = False
    for (x1, y1), (x2, y2) in segments(ring):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_random_shapes_against_brute_force(spark):
    rnd = random.Random(5)
    one = [(i, star(rnd, rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.uniform(0.3, 3), 7)) for i in range(60)]
    two = [(i, star(rnd, rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.uniform(0.3, 4), 6)) for i in range(50)]
    want = sorted(
        (i, j)
        for i, r in one
        for j, s in two
        if any(cross(e, f) for e in segments(r) for f in segments(s)) or holds(s, r[0]) or holds(r, s[0])
    )
    a = layer(spark, [(i, [r]) for i, r in one])
    b = layer(spark, [(i, [r]) for i, r in two])
    assert sorted(rows(X.spatial_join(a, b), "a_id", "b_id")) == want
    assert sorted(rows(X.spatial_join(a, b, 0.9), "a_id", "b_id")) == want


def test_one_huge_polygon_makes_few_rows(spark):
    """A polygon a million tiles wide meets small ones on a coarse level."""
    huge = layer(spark, [(1, [box(-5e5, -5e5, 1e6, 1e6)]), (2, [box(3, 3, 1, 1)])])
    small = layer(spark, [(i, [box(i, i, 0.5, 0.5)]) for i in range(40)])
    prepared = X._prepared(huge, "id", "a", 1.0)
    tiles = X._tiled(prepared, "a", X._levels(prepared, "a"), 1.0)
    assert tiles.where("a_id = 1").count() <= 4
    got = rows(X.spatial_join(small, huge, 1.0), "a_id", "b_id")
    assert got == sorted([(i, 1) for i in range(40)] + [(3, 2), (4, 2)], key=repr)
    assert len(rows(X.spatial_join(huge, small, 1.0))) == 42


def test_no_shuffle_carries_rings(spark, capsys):
    """Polygons of 10,000 vertices meet by boxes, single edges and bands of edges."""
    def wheel(cx, cy, size):
        return [(cx + size * math.cos(k / 5000 * math.pi), cy + size * math.sin(k / 5000 * math.pi)) for k in range(10000)]

    one = layer(spark, [(1, [wheel(0, 0, 10)]), (2, [wheel(30, 0, 5)])])
    two = layer(spark, [(7, [wheel(0, 0, 3)]), (8, [wheel(15, 0, 5.5)]), (9, [wheel(22, 0, 2)])])
    met = X.spatial_join(one, two)
    assert rows(met, "a_id", "b_id") == [(1, 7), (1, 8)]
    met.explain("formatted")
    operators = [p.strip("\n") for p in capsys.readouterr().out.split("\n\n")]
    exchanges = [p for p in operators if "Exchange" in p.split("\n")[0] and p.startswith("(")]
    assert exchanges and not any("rings" in p for p in exchanges)
    widest = X._banded(one, "id").agg(F.max(F.size("edges"))).first()[0]
    assert widest < 1000


def boundary(shapes, n):
    """Cells of an n x n grid that shapes cover, and the outline's unit segments."""
    cells = {(x, y) for sx, sy, w, h in shapes for x in range(sx, sx + w) for y in range(sy, sy + h)}
    sides = {}
    for x, y in cells:
        for s in ((x, y, x + 1, y), (x, y + 1, x + 1, y + 1), (x, y, x, y + 1), (x + 1, y, x + 1, y + 1)):
            sides[s] = sides.get(s, 0) + 1
    return {s for s, k in sides.items() if k == 1}


def split(rnd, x, y, w, h):
    """Random unequal rectangles that tile a rectangle: neighbours meet in T-junctions."""
    if w * h < 6 or (w < 2 and h < 2):
        return [(x, y, w, h)]
    if w >= h:
        k = rnd.randint(1, w - 1)
        return split(rnd, x, y, k, h) + split(rnd, x + k, y, w - k, h)
    k = rnd.randint(1, h - 1)
    return split(rnd, x, y, w, k) + split(rnd, x, y + k, w, h - k)


@pytest.mark.parametrize("slant", [(1, 0, 0, 1), (3, 1, -1, 2), (0.5, -0.25, 0.75, 1)])
def test_dissolve_of_unequal_rectangles(spark, slant):
    """The outline of random tiles, also under a linear map that slants them."""
    a, b, c, d = slant
    rnd = random.Random(8)
    tiles = [(rnd.choice("pqr"), t) for t in split(rnd, 0, 0, 17, 13)]

    def at(x, y):
        return (float(a * x + c * y), float(b * x + d * y))

    frame = spark.createDataFrame(
        [(k, [[at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)]]) for k, (x, y, w, h) in tiles],
        f"k string, rings {Y.RINGS_TYPE}",
    )
    got = X.dissolve_noded(frame, ["k"]).collect()
    for key in "pqr":
        want = boundary([t for k, t in tiles if k == key], 17)
        length = sum(math.dist(at(*s[:2]), at(*s[2:])) for s in want)
        mine = [r for r in got if r["k"] == key]
        assert sum(math.dist((r["x1"], r["y1"]), (r["x2"], r["y2"])) for r in mine) == pytest.approx(length)
        ends = {p for r in mine for p in ((r["x1"], r["y1"]), (r["x2"], r["y2"]))}
        corners = {at(*p) for s in want for p in (s[:2], s[2:])}
        assert {tuple(round(v, 6) for v in p) for p in ends} <= {tuple(round(v, 6) for v in p) for p in corners}


def test_points_in_polygons(spark):
    rnd = random.Random(12)
    stars = [(i, star(rnd, rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.uniform(1, 6), 40)) for i in range(25)]
    spots = [(i, rnd.uniform(0, 20), rnd.uniform(0, 20)) for i in range(300)] + [(500, *stars[0][1][3]), (501, 99.0, 99.0)]
    want = sorted((i, j) for i, x, y in spots[:300] for j, ring in stars if holds(ring, (x, y)))
    areas = layer(spark, [(i, [r]) for i, r in stars])
    for tile in (0.5, 4.0, None):
        found = X.points_in(spark.createDataFrame(spots, "id int, x double, y double"), areas, tile).collect()
        assert sorted((r["id"], r["area_id"]) for r in found if r["id"] < 500) == want
        assert (500, 0) in {(r["id"], r["area_id"]) for r in found}
    holed = layer(spark, [(1, [box(0, 0, 4, 4), box(1, 1, 2, 2)])])
    places = [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, 4.0, 4.0), (5, 2.0, 0.0), (6, 4.0, 5.0)]
    inside = X.points_in(spark.createDataFrame(places, "id int, x double, y double"), holed)
    assert rows(inside, "id") == [(1,), (3,), (4,), (5,)]
