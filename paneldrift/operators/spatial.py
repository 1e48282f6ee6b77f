"""Polygon layers: tile-bucketed intersection join, area assignment, dissolve, layer extent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounding_box, boxes_overlap, edges, edges_meet, polygons_intersect, sql_gcd, sql_point_inside
from .scale import join_on, numbered


#: Edges of a polygon that a band of it holds, about.
BAND_EDGES = 16


def _levelled(items: DataFrame, prefix: str, tile: float) -> DataFrame:
    """Items with the level of their box.

    Level l has tiles of side tile * 2^l; an item's own level is the first one whose tiles are at
    least as long as its box, so its box touches four tiles there at most.
    """
    box = f"{prefix}_box"
    side = f"greatest({box}.x2 - {box}.x1, {box}.y2 - {box}.y1)"
    level = f"int(greatest(ceil(log2(greatest({side} / {tile!r}D, 1D))), 0))"
    return items.withColumn(f"{prefix}_level", F.expr(level))


def _boxes(layer: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """id and box of a layer's polygons, and their number of bands: one for about BAND_EDGES edges."""
    bands = F.expr(f"greatest(aggregate(rings, 0, (n, r) -> n + size(r)) div {BAND_EDGES}, 1L)")
    return layer.select(
        F.col(id_col).alias(f"{prefix}_id"), bounding_box("rings").alias(f"{prefix}_box"), bands.alias(f"{prefix}_bands")
    )


def _band(y: str, box: str, bands: str) -> str:
    """Which of a polygon's horizontal bands, all of one height, holds y; the last has its upper border."""
    height = f"(({box}.y2 - {box}.y1) / {bands})"
    return f"IF({height} > 0, least(floor(({y} - {box}.y1) / {height}), {bands} - 1), 0L)"


def _prepared(layer: DataFrame, id_col: str, prefix: str, tile: float) -> DataFrame:
    """id, box and level of a layer's polygons."""
    return _levelled(_boxes(layer, id_col, prefix), prefix, tile)


def _levels(prepared: DataFrame, prefix: str) -> Column:
    """The levels a layer uses (one aggregated row): a few dozen at most, as sides are doubles."""
    return prepared.agg(F.collect_set(f"{prefix}_level").alias("levels")).scalar()


def _tiled(prepared: DataFrame, prefix: str, other_levels: Column, tile: float) -> DataFrame:
    """One row per tile an item's box touches, on its own level and on every coarser level the
    other side uses: however large an item, four tiles per level."""
    level, box = f"{prefix}_level", f"{prefix}_box"
    coarser = F.filter("_levels", lambda other: other > F.col(level))

    def tiles(axis: str) -> Column:
        first, last = (
            f"floor({box}.{axis}{i} / ({tile!r}D * pow(2D, level)))" for i in (1, 2)
        )
        return F.expr(f"explode(sequence({first}, {last}))")

    return (
        prepared.withColumn("_levels", other_levels)
        .withColumn("level", F.explode(F.concat(F.array(level), coarser)))
        .drop("_levels")
        .withColumn("tx", tiles("x"))
        .withColumn("ty", tiles("y"))
    )


def suggest_tile(layer: DataFrame) -> float:
    """Tile side for a layer: the mean of its polygons' longer box sides (one aggregated row)."""
    box = bounding_box("rings")
    longer = F.greatest(box["x2"] - box["x1"], box["y2"] - box["y1"])
    side = layer.agg(F.avg(longer).alias("side")).first()["side"]
    return float(side) if side else 1.0


def box_join(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """All pairs of items (with a_box and b_box) whose boxes share a point, each once.

    Both sides are bucketed by tiles and joined on the tile. Tiles come in levels of doubling size
    (smallest side ``tile``), and a pair meets on the coarser of its two levels, so neither large nor
    small items make many rows. A pair is kept only in the tile that holds the lower left corner of the
    two boxes' overlap, so nothing has to be de-duplicated afterwards. Rows are as slim as the items;
    a crowded tile is split by the skew join of adaptive execution.
    """
    one, two = _levelled(a, "a", tile), _levelled(b, "b", tile)
    left = _tiled(one, "a", _levels(two, "b"), tile)
    right = _tiled(two, "b", _levels(one, "a"), tile)
    side = f"({tile!r}D * pow(2D, level))"
    owner = F.expr(
        "level = greatest(a_level, b_level) AND "
        f"tx = floor(greatest(a_box.x1, b_box.x1) / {side}) AND "
        f"ty = floor(greatest(a_box.y1, b_box.y1) / {side})"
    )
    met = join_on(left, right, ["level", "tx", "ty"]).where(boxes_overlap("a_box", "b_box") & owner)
    return met.drop("level", "tx", "ty", "a_level", "b_level")


def _edge_items(layer: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """One row per edge with its own box."""
    e = f"{prefix}_edge"
    box = (
        f"named_struct('x1', least({e}.a.x, {e}.b.x), 'y1', least({e}.a.y, {e}.b.y), "
        f"'x2', greatest({e}.a.x, {e}.b.x), 'y2', greatest({e}.a.y, {e}.b.y))"
    )
    rows = layer.select(F.col(id_col).alias(f"{prefix}_id"), F.explode(edges("rings")).alias(e))
    return rows.withColumn(f"{prefix}_box", F.expr(box))


def _banded(layer: DataFrame, id_col: str) -> DataFrame:
    """Edges of each polygon by bands: outer, band, edges. A ray through a polygon meets the edges of
    one band, however many the polygon has."""
    rows = layer.select(
        F.col(id_col).alias("outer"),
        bounding_box("rings").alias("o_box"),
        F.expr(f"greatest(aggregate(rings, 0, (n, r) -> n + size(r)) div {BAND_EDGES}, 1L)").alias("o_bands"),
        F.explode(edges("rings")).alias("edge"),
    )
    low, high = (_band(f"{end}(edge.a.y, edge.b.y)", "o_box", "o_bands") for end in ("least", "greatest"))
    banded = rows.select("outer", "edge", F.expr(f"explode(sequence({low}, {high}))").alias("band"))
    return banded.groupBy("outer", "band").agg(F.collect_list("edge").alias("edges"))


def _inside(candidates: DataFrame, banded: DataFrame) -> DataFrame:
    """Candidates (outer, its box o_box and bands o_bands, x, y) whose point lies in the polygon
    ``outer`` or on its border: a ray test on the edges of the point's band, which alone travel."""
    placed = candidates.withColumn("band", F.expr(_band("y", "o_box", "o_bands"))).drop("o_box", "o_bands")
    on_border = (
        "exists(edges, e -> (e.b.x - e.a.x) * (y - e.a.y) = (e.b.y - e.a.y) * (x - e.a.x) "
        "AND x BETWEEN least(e.a.x, e.b.x) AND greatest(e.a.x, e.b.x) "
        "AND y BETWEEN least(e.a.y, e.b.y) AND greatest(e.a.y, e.b.y))"
    )
    met = join_on(placed, banded, ["outer", "band"])
    return met.where(F.expr(f"{sql_point_inside('edges', 'x', 'y')} OR {on_border}")).drop("band", "edges")


def points_in(points: DataFrame, layer: DataFrame, tile: float | None = None, id_col: str = "id") -> DataFrame:
    """(the points' columns, area_id) of all points in or on the border of a layer's polygons.

    ``points`` has x and y. A point meets the polygons of its tiles by their boxes first.
    """
    tile = suggest_tile(layer) if tile is None else float(tile)
    at = F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = box_join(points.withColumn("a_box", at), _boxes(layer, id_col, "b"), tile).drop("a_box")
    met = met.withColumnsRenamed({"b_id": "outer", "b_box": "o_box", "b_bands": "o_bands"})
    return _inside(met, _banded(layer, id_col)).withColumnRenamed("outer", "area_id")


def spatial_join(
    a: DataFrame,
    b: DataFrame,
    tile: float | None = None,
    a_id: str = "id",
    b_id: str = "id",
) -> DataFrame:
    """(a_id, b_id) of all polygons that share a point, touching included.

    Polygons share a point if edges of theirs meet or a ring of one starts in the other. Edges are
    bucketed by tiles of their own (smallest side ``tile``, default from layer b), so only edges of a
    shared tile meet. For the other case ids and boxes meet first, and a ring's start is then tested
    against the few edges of its band, for both directions at once. No row holds a polygon's rings,
    however many vertices they have. Only where no polygon of either layer has more vertices than a band
    holds, as in layers of rectangles, they travel with their boxes and one join does.
    """
    tile = suggest_tile(b) if tile is None else float(tile)
    vertices = F.expr("aggregate(rings, 0, (n, r) -> n + size(r))")
    widest = a.select(vertices.alias("n")).union(b.select(vertices.alias("n"))).agg(F.max("n")).first()[0]
    if (widest or 0) <= BAND_EDGES:
        one, two = (
            layer.select(
                F.col(identity).alias(f"{p}_id"), F.col("rings").alias(f"{p}_rings"), bounding_box("rings").alias(f"{p}_box")
            )
            for layer, identity, p in ((a, a_id, "a"), (b, b_id, "b"))
        )
        exact = polygons_intersect("a_rings", "a_box", "b_rings", "b_box")
        return box_join(one, two, tile).where(exact).select("a_id", "b_id")
    crossing = box_join(_edge_items(a, a_id, "a"), _edge_items(b, b_id, "b"), tile)
    crossing = crossing.where(edges_meet("a_edge", "b_edge")).select("a_id", "b_id")

    # both layers as one: a polygon is known by its side and id
    def sided(side: str, identity: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(identity).cast("string").alias("id"))

    both = a.select(sided("a", a_id).alias("key"), "rings").union(b.select(sided("b", b_id).alias("key"), "rings"))
    ring = F.explode("rings").alias("ring")
    first = F.get("ring", F.lit(0))
    starts = both.select(F.col("key").alias("inner"), ring).select("inner", first["x"].alias("x"), first["y"].alias("y"))
    ways = F.array(
        *[
            F.struct(
                sided(mine, f"{mine}_id").alias("inner"),
                sided(other, f"{other}_id").alias("outer"),
                F.col(f"{other}_box").alias("o_box"),
                F.col(f"{other}_bands").alias("o_bands"),
            )
            for mine, other in (("a", "b"), ("b", "a"))
        ]
    )
    near = box_join(_boxes(a, a_id, "a"), _boxes(b, b_id, "b"), tile).select("a_id", "b_id", F.inline(ways))
    held = F.expr("x BETWEEN o_box.x1 AND o_box.x2 AND y BETWEEN o_box.y1 AND o_box.y2")
    at = join_on(near, starts, ["inner"]).where(held).drop("inner")
    inside = _inside(at, _banded(both, "key")).select("a_id", "b_id")
    return crossing.unionByName(inside).distinct()


def assign_area(
    units: DataFrame,
    areas: DataFrame,
    name: str = "name",
    order: str = "ord",
    unit_id: str = "id",
    area_id: str = "id",
    tile: float | None = None,
    out: str = "area",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Each unit gets the last intersecting area in layer order, '' when there is none; ``keep``
    names further columns of the units to return."""
    pairs = spatial_join(units, areas, tile, unit_id, area_id)
    labels = areas.select(F.col(area_id).alias("b_id"), name, order)
    last = (
        join_on(pairs, labels, ["b_id"], null_safe=False)
        .groupBy(F.col("a_id").alias(unit_id))
        .agg(F.max_by(name, order).alias(out))
    )
    return join_on(units.select(unit_id, *keep), last, [unit_id], "left", null_safe=False).withColumn(
        out, F.coalesce(out, F.lit(""))
    )


def dissolve(layer: DataFrame, by: Sequence[str]) -> DataFrame:
    """Boundary edges (x1, y1, x2, y2) per key: edges shared by two member polygons cancel out.

    Valid for coverages, whose neighbours share vertices; the edge's end points are ordered.
    """
    e = F.col("_e")
    first = F.least(e["a"], e["b"])
    second = F.greatest(e["a"], e["b"])
    return (
        layer.select(*by, F.explode(edges("rings")).alias("_e"))
        .select(
            *by,
            first["x"].alias("x1"),
            first["y"].alias("y1"),
            second["x"].alias("x2"),
            second["y"].alias("y2"),
        )
        .groupBy(*by, "x1", "y1", "x2", "y2")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def dissolve_noded(layer: DataFrame, by: Sequence[str], scale: int = 1_000_000) -> DataFrame:
    """Boundary segments (x1, y1, x2, y2) per key of coverages whose neighbours need not share vertices.

    Coordinates are snapped to a grid of 1 / scale. Every edge lies on a line, which is known exactly by
    its reduced direction and its offset in whole numbers. On a line, a place where an odd number of
    edges end is where the boundary begins or stops, whatever vertices the neighbours have there;
    all other ends cancel. The places of a line, in order, pair up to its boundary segments, collinear
    ones merged. Segments go from their smaller to their larger end.
    """
    def snapped(end: str, axis: str) -> str:
        return f"CAST(round(_e.{end}.{axis} * {scale}) AS BIGINT)"

    ends = layer.select(*by, F.explode(edges("rings")).alias("_e")).selectExpr(
        *[f"`{c}`" for c in by],
        *[f"{snapped(end, axis)} AS {axis}{i}" for i, end in ((1, "a"), (2, "b")) for axis in "xy"],
    )
    turned = "(x2 < x1 OR (x2 = x1 AND y2 < y1))"
    line = (
        ends.where("x1 <> x2 OR y1 <> y2")
        .selectExpr("*", f"IF({turned}, x1 - x2, x2 - x1) AS dx", f"IF({turned}, y1 - y2, y2 - y1) AS dy")
        .selectExpr("*", f"{sql_gcd('dx', 'dy')} AS g")
        .selectExpr(*[f"`{c}`" for c in by], "x1", "y1", "x2", "y2", "dx div g AS ux", "dy div g AS uy")
    )
    whole = "CAST({} AS DECIMAL(19, 0))"
    offset = f"{whole.format('ux')} * {whole.format('y1')} - {whole.format('uy')} * {whole.format('x1')} AS c"
    keys = [*by, "ux", "uy", "c"]
    places = (
        line.selectExpr("*", offset)
        .select(*keys, F.explode(F.expr("IF(ux <> 0, array(x1, x2), array(y1, y2))")).alias("t"))
        .groupBy(*keys, "t")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n % 2 = 1")
        .drop("n")
    )
    pairs = (
        numbered(places, keys, [F.col("t").asc()])
        .groupBy(*keys, F.expr("(rn + 1) div 2").alias("_pair"))
        .agg(F.min("t").alias("t1"), F.max("t").alias("t2"))
    )

    def coordinate(axis: str, t: str) -> Column:
        other = f"(c + {whole.format('uy')} * {whole.format(t)}) / {whole.format('ux')}"
        value = f"IF(ux <> 0, {t}, -c)" if axis == "x" else f"IF(ux <> 0, {other}, {t})"
        return F.expr(f"CAST({value} AS DOUBLE) / {float(scale)!r}D").alias(f"{axis}{t[-1]}")

    return pairs.select(*by, *[coordinate(axis, t) for t in ("t1", "t2") for axis in "xy"])


def layer_bbox(layer: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Extent of a layer, or of each key's polygons."""
    box = bounding_box("rings")
    boxes = layer.select(*by, box.alias("_b"))
    return boxes.groupBy(*by).agg(
        F.min("_b.x1").alias("xmin"),
        F.min("_b.y1").alias("ymin"),
        F.max("_b.x2").alias("xmax"),
        F.max("_b.y2").alias("ymax"),
    )


def points(df: DataFrame, lon: str, lat: str, crs: str = "EPSG:4269") -> DataFrame:
    """Point features: struct<x, y> and a reference-system tag (WGS84 and NAD83 count as equal)."""
    xy = F.struct(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    return df.withColumns({"point": xy, "crs": F.lit(crs)})


def prepare_layer(
    layer: DataFrame,
    keep: DataFrame | None = None,
    key: str = "name",
    drop: Sequence[str] = (),
    recode: tuple[str, Column] | None = None,
) -> DataFrame:
    """Filter a layer to known keys, drop attributes and recode one of them."""
    out = layer
    if keep is not None:
        out = join_on(out, keep.select(key).distinct(), [key], "left_semi", null_safe=False)
    if recode is not None:
        out = out.withColumn(*recode)
    return out.drop(*drop)

