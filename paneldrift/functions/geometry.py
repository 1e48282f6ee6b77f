"""Polygon expressions on ``rings``: array<array<struct<x double, y double>>>.

A polygon is any number of closed or open rings under the even-odd rule: parts of a
multi-polygon and holes are further rings. All functions are built-in higher-order
expressions, so geometry stays an ordinary column. The ``sql_*`` helpers compose SQL text,
which keeps the deeply nested lambdas readable and cheap to build.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ColumnLike, col

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"
EARTH_RADIUS_KM = 6371.0088


def point(x: ColumnLike, y: ColumnLike) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def rectangle_sql(x: str, y: str, w: str, h: str) -> str:
    """One closed ring around (x, y) .. (x + w, y + h), as SQL text over SQL operands."""
    corners = [(x, y), (f"{x} + {w}", y), (f"{x} + {w}", f"{y} + {h}"), (x, f"{y} + {h}"), (x, y)]
    points = ", ".join(
        f"named_struct('x', double({a}), 'y', double({b}))" for a, b in corners
    )
    return f"array(array({points}))"


def rectangle(x: str, y: str, w: str, h: str) -> Column:
    return F.expr(rectangle_sql(f"({x})", f"({y})", f"({w})", f"({h})"))


def sql_ring_edges(ring: str) -> str:
    """array<struct<a, b>> of a ring's edges; an open ring is closed, empty edges are dropped."""
    following = f"concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1))"
    return (
        f"filter(zip_with({ring}, {following}, (p, q) -> named_struct('a', p, 'b', q)), "
        "e -> e.a.x <> e.b.x OR e.a.y <> e.b.y)"
    )


def sql_edges(rings: str) -> str:
    """All edges of all rings."""
    return f"flatten(transform({rings}, r -> {sql_ring_edges('r')}))"


def edges(rings: str) -> Column:
    return F.expr(sql_edges(rings))


def _sql_sum(array: str) -> str:
    return f"aggregate({array}, 0D, (total, v) -> total + v)"


def sql_point_inside(edge_list: str, x: str, y: str) -> str:
    """Even-odd test: an odd number of edges crosses the ray from the point to the right.

    Written without a division.
    """
    side = f"(({x} - e.a.x) * (e.b.y - e.a.y) - (e.b.x - e.a.x) * ({y} - e.a.y))"
    return (
        f"size(filter({edge_list}, e -> "
        f"(e.a.y <= {y} AND e.b.y > {y} AND {side} < 0) OR "
        f"(e.a.y > {y} AND e.b.y <= {y} AND {side} > 0))) % 2 = 1"
    )


def _sql_ring_signs(rings: str) -> str:
    """+1 for a ring outside or inside an even number of other rings, -1 for a hole."""
    inside = sql_point_inside(sql_ring_edges("o"), "get(s, 0).x", "get(s, 0).y")
    depth = f"size(filter({rings}, (o, j) -> j <> i AND {inside}))"
    signs = f"transform({rings}, (s, i) -> IF({depth} % 2 = 0, 1D, -1D))"
    return f"IF(size({rings}) = 1, array(1D), {signs})"


_CROSS = "(e.a.x * e.b.y - e.b.x * e.a.y)"
_SPHERE = "(radians(e.b.x - e.a.x) * (sin(radians(e.a.y)) + sin(radians(e.b.y))))"


def _sql_over_edges(ring: str, term: str) -> str:
    """Sum of a term over the edges ``e`` of a ring."""
    return _sql_sum(f"transform({sql_ring_edges(ring)}, e -> {term})")


def sql_ring_turn(ring: str) -> str:
    """Twice the signed area of a ring: positive if it runs counter-clockwise."""
    return _sql_over_edges(ring, _CROSS)


def _sql_signed(rings: str, per_ring: str) -> str:
    """Sum of a value per ring ``r``, holes counted negative."""
    return _sql_sum(
        f"zip_with(transform({rings}, r -> {per_ring}), {_sql_ring_signs(rings)}, (a, s) -> a * s)"
    )


def _sql_area(rings: str, term: str) -> str:
    return _sql_signed(rings, f"abs({_sql_over_edges('r', term)})")


def polygon_area(rings: str, mode: str = "planar") -> Column:
    """Area of a polygon: planar in squared units, or spherical in km2 from lon/lat degrees."""
    if mode == "planar":
        return F.expr(f"0.5D * {_sql_area(rings, _CROSS)}")
    if mode == "spherical":
        return F.expr(f"{0.5 * EARTH_RADIUS_KM**2!r}D * {_sql_area(rings, _SPHERE)}")
    raise ValueError("mode is 'planar' or 'spherical'")


def polygon_centroid(rings: str) -> Column:
    """Area-weighted centroid as struct<x, y>, NULL for an empty polygon."""

    def moment(axis: str) -> str:
        turn = _sql_over_edges("r", _CROSS)
        total = _sql_over_edges("r", f"(e.a.{axis} + e.b.{axis}) * {_CROSS}")
        return _sql_signed(rings, f"IF({turn} < 0, -{total}, {total})")

    six_areas = f"(3D * {_sql_area(rings, _CROSS)})"
    x, y = (f"try_divide({moment(axis)}, {six_areas})" for axis in "xy")
    return F.expr(f"IF({six_areas} <> 0, named_struct('x', {x}, 'y', {y}), NULL)")


def bounding_box(rings: str) -> Column:
    """struct<x1, y1, x2, y2> around a polygon."""
    xs = f"transform(flatten({rings}), p -> p.x)"
    ys = f"transform(flatten({rings}), p -> p.y)"
    return F.expr(
        f"named_struct('x1', array_min({xs}), 'y1', array_min({ys}), "
        f"'x2', array_max({xs}), 'y2', array_max({ys}))"
    )


def sql_boxes_overlap(a: str, b: str) -> str:
    """Do two boxes share a point? Touching counts."""
    return (
        f"({a}.x1 <= {b}.x2 AND {b}.x1 <= {a}.x2 AND {a}.y1 <= {b}.y2 AND {b}.y1 <= {a}.y2)"
    )


def boxes_overlap(a: str, b: str) -> Column:
    return F.expr(sql_boxes_overlap(a, b))


def _sql_edge_reaches(e: str, box: str) -> str:
    """Does the box of an edge overlap a box?"""
    return (
        f"(least({e}.a.x, {e}.b.x) <= {box}.x2 AND greatest({e}.a.x, {e}.b.x) >= {box}.x1 AND "
        f"least({e}.a.y, {e}.b.y) <= {box}.y2 AND greatest({e}.a.y, {e}.b.y) >= {box}.y1)"
    )


def _sql_turn(p: str, q: str, r: str) -> str:
    return f"signum(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"


def _sql_edges_meet(e: str, f: str) -> str:
    """Do two edges share a point? Touching counts: the boxes of the edges overlap and the end
    points of neither edge lie strictly on one side of the other."""
    boxes = " AND ".join(
        f"greatest({a}.a.{k}, {a}.b.{k}) >= least({b}.a.{k}, {b}.b.{k})"
        for a, b in ((e, f), (f, e))
        for k in "xy"
    )
    across = f"{_sql_turn(f'{e}.a', f'{e}.b', f'{f}.a')} * {_sql_turn(f'{e}.a', f'{e}.b', f'{f}.b')} <= 0"
    back = f"{_sql_turn(f'{f}.a', f'{f}.b', f'{e}.a')} * {_sql_turn(f'{f}.a', f'{f}.b', f'{e}.b')} <= 0"
    return f"({boxes} AND {across} AND {back})"


def edges_meet(e: str, f: str) -> Column:
    """Do two edge columns share a point? Touching counts."""
    return F.expr(_sql_edges_meet(e, f))


def sql_gcd(a: str, b: str) -> str:
    """Greatest common divisor of two whole numbers that are not both zero; 92 steps of Euclid's
    algorithm reach it for any 64-bit numbers."""
    step = "(s, i) -> IF(s.b = 0, s, named_struct('a', s.b, 'b', s.a - s.b * (s.a div nullif(s.b, 0))))"
    start = f"named_struct('a', nullif(abs({a}), -1), 'b', nullif(abs({b}), -1))"
    euclid = f"aggregate(sequence(1, 92), {start}, {step}, s -> s.a)"
    return f"IF({a} = 0 OR {b} = 0, abs({a} + {b}), {euclid})"


def polygons_intersect(rings_a: str, box_a: str, rings_b: str, box_b: str) -> Column:
    """Do two polygons share a point? Touching counts; a polygon inside a hole does not.

    Cheap tests come first: a ring of one starting inside the other. Otherwise edges must meet,
    and only edges reaching into the other polygon's box are compared with each other; the
    one-element array binds both edge lists once per pair.
    """
    near_a = f"filter({sql_edges(rings_a)}, e -> {_sql_edge_reaches('e', box_b)})"
    near_b = f"filter({sql_edges(rings_b)}, f -> {_sql_edge_reaches('f', box_a)})"
    meet = (
        f"exists(array(named_struct('na', {near_a}, 'nb', {near_b})), "
        f"t -> exists(t.na, e -> exists(t.nb, f -> {_sql_edges_meet('e', 'f')})))"
    )

    def start_inside(rings: str, other: str) -> str:
        test = sql_point_inside("t.all", "get(s, 0).x", "get(s, 0).y")
        return (
            f"exists(array(named_struct('all', {sql_edges(other)})), "
            f"t -> exists({rings}, s -> {test}))"
        )

    return F.expr(
        f"{start_inside(rings_a, rings_b)} OR {start_inside(rings_b, rings_a)} OR {meet}"
    )
