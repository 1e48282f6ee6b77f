"""Queries on polygon layers, area roll-ups and regression, following one chain:

parts are assigned to supplier areas, their yearly quantities are classified and rolled up,
and the areas' change is modelled on size, price and line-type shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import point, polygon_area as area_of, polygon_centroid as centroid_of
from ..operators import areas as A
from ..operators import classes as C
from ..operators import growth as G
from ..operators import spatial as X
from ..operators import stats as M
from ..operators.pairs import pair_values
from ..operators.reshape import top_k_signed
from ..operators.scale import durable_table, join_on
from . import sql as S
from .bindings import (
    Tables,
    brick_wall,
    part_corners,
    part_layer,
    part_panel,
    part_profile,
    stored,
    supplier_grid,
    supplier_layer,
)
from .registry import query, rounded

TILE = 35.0
PROFILE = ["singd", "semd", "row", "income", "apt"]


def _holed() -> Column:
    """Part rectangles grown by one on every side, with the rectangle itself as a hole."""
    outer = F.col("rings")
    ring = F.get(outer, F.lit(0))
    lo, hi = F.get(ring, F.lit(0)), F.get(ring, F.lit(2))
    x1, y1, x2, y2 = lo["x"] - 1, lo["y"] - 1, hi["x"] + 1, hi["y"] + 1
    frame = F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2))
    return F.array(frame, ring)


@query(
    S.with_(S.PARTS)
    + """SELECT id, (w * h)::DOUBLE AS area, ((w + 2) * (h + 2) - w * h)::DOUBLE AS frame_area,
         round(6371.0088 * 6371.0088 * radians(w / 100.0::DOUBLE)
         * (sin(radians((y + h) / 100.0::DOUBLE)) - sin(radians(y / 100.0::DOUBLE))), 4) AS km2
         FROM parts"""
)
def polygon_area(t: Tables) -> DataFrame:
    lonlat = "transform(rings, r -> transform(r, p -> named_struct('x', p.x / 100, 'y', p.y / 100)))"
    return part_layer(t, _holed().alias("frame")).select(
        "id",
        area_of("rings").alias("area"),
        F.round(area_of(lonlat, "spherical"), 4).alias("km2"),
        area_of("frame").alias("frame_area"),
    )


@query(
    S.with_(S.PARTS) + "SELECT id, x + w / 2.0::DOUBLE AS x, y + h / 2.0::DOUBLE AS y FROM parts"
)
def polygon_centroid(t: Tables) -> DataFrame:
    c = centroid_of("rings")
    return rounded(part_layer(t).select("id", c.alias("c")).select("id", "c.x", "c.y"), "x", "y")


@query(
    S.with_(S.PARTS)
    + """SELECT p_type AS kind, min(x)::DOUBLE AS xmin, min(y)::DOUBLE AS ymin,
         max(x + w)::DOUBLE AS xmax, max(y + h)::DOUBLE AS ymax
         FROM parts JOIN part ON id = p_partkey GROUP BY 1"""
)
def layer_bbox(t: Tables) -> DataFrame:
    return X.layer_bbox(part_layer(t, F.col("p_type").alias("kind")), ["kind"])


@query(S.with_(S.PARTS, S.SUPPLIERS, S.HITS) + "SELECT a_id, b_id FROM hits")
def spatial_intersects(t: Tables) -> DataFrame:
    return X.spatial_join(part_layer(t), supplier_layer(t), TILE)


def _unit_areas(t: Tables) -> DataFrame:
    """unit, parent (brand), area ('' when outside all areas)."""
    parts = part_layer(t, F.col("p_brand").alias("parent"))
    assigned = X.assign_area(parts, supplier_layer(t), tile=TILE, keep=["parent"])
    return assigned.withColumnRenamed("id", "unit")


@query(S.with_(*S.SPACE) + "SELECT unit, parent, area FROM dict")
def spatial_assign(t: Tables) -> DataFrame:
    return _unit_areas(t)


@query(
    """WITH g AS (SELECT s_nationkey AS nation, s_suppkey % 10 AS x, s_suppkey // 10 AS y FROM supplier),
    e AS (SELECT nation, x AS x1, y AS y1, x + 1 AS x2, y AS y2 FROM g
          UNION ALL SELECT nation, x, y + 1, x + 1, y + 1 FROM g
          UNION ALL SELECT nation, x, y, x, y + 1 FROM g
          UNION ALL SELECT nation, x + 1, y, x + 1, y + 1 FROM g)
    SELECT nation, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2
    FROM e GROUP BY ALL HAVING count(*) = 1"""
)
def dissolve_edges(t: Tables) -> DataFrame:
    return X.dissolve(supplier_grid(t), ["nation"])


@query(
    """WITH bricks AS (SELECT c_nationkey AS nation, c_custkey // 60 AS y, c_custkey // 60 % 3 + 1 AS w,
                             c_custkey % 60 * (c_custkey // 60 % 3 + 1) AS x FROM customer),
    units AS (SELECT nation, 'h' AS way, y + d AS line, x + u AS t FROM bricks, range(2) a(d), range(3) b(u) WHERE u < w
              UNION ALL SELECT nation, 'v', x + d * w, y FROM bricks, range(2) a(d)),
    odd AS (SELECT nation, way, line, t FROM units GROUP BY ALL HAVING count(*) % 2 = 1),
    runs AS (SELECT nation, way, line, min(t) AS t1, max(t) + 1 AS t2
             FROM (SELECT *, t - row_number() OVER (PARTITION BY nation, way, line ORDER BY t) AS run FROM odd)
             GROUP BY nation, way, line, run)
    SELECT nation, (CASE way WHEN 'h' THEN t1 ELSE line END)::DOUBLE AS x1, (CASE way WHEN 'h' THEN line ELSE t1 END)::DOUBLE AS y1,
           (CASE way WHEN 'h' THEN t2 ELSE line END)::DOUBLE AS x2, (CASE way WHEN 'h' THEN line ELSE t2 END)::DOUBLE AS y2
    FROM runs"""
)
def dissolve_bricks(t: Tables) -> DataFrame:
    """Boundary of each nation's bricks, whose neighbours meet in T-junctions."""
    return X.dissolve_noded(brick_wall(t), ["nation"])


@query(
    S.with_(S.SUPPLIERS)
    + """SELECT p_partkey AS id, upper(name) AS name, area_id, 'EPSG:4269' AS crs
         FROM part JOIN (SELECT s.id AS area_id, s.* FROM suppliers s JOIN supplier ON s.id = s_suppkey WHERE s_acctbal > 0) s
         ON p_partkey % 100 * 7 BETWEEN x AND x + w AND p_partkey // 100 * 5 BETWEEN y AND y + h"""
)
def points_in_areas(t: Tables) -> DataFrame:
    """Point features in a prepared layer: the areas of suppliers in credit, touching counts."""
    credit = t.supplier.where("s_acctbal > 0").select(F.col("s_name").alias("name"))
    layer = X.prepare_layer(supplier_layer(t), credit, "name", drop=["ord"], recode=("name", F.upper("name")))
    corners = X.points(part_corners(t), "lon", "lat").select("id", "crs", "point.x", "point.y")
    found = X.points_in(corners, layer, TILE)
    names = layer.select(F.col("id").alias("area_id"), "name")
    return join_on(found, names, ["area_id"]).select("id", "name", "area_id", "crs")


def _area_table(t: Tables) -> DataFrame:
    """The unit dictionary, written once: the roll-ups read it several times."""
    return durable_table(_unit_areas(t))


def _cube(t: Tables, areas: DataFrame) -> DataFrame:
    return A.area_cube(C.change_class(pair_values(stored(part_panel(t)))), areas, parent="parent")


def _rolled(cube: DataFrame) -> DataFrame:
    return A.cube_rollup(cube, breaks=S.ROLLUP_BREAKS, rename={"Brand#1": "Old Brand"})


@query(S.with_(*S.SPACE_CHAIN) + "SELECT area, d_m, parent, gg FROM rolled")
def rollup_area(t: Tables) -> DataFrame:
    return A.largest_first(_rolled(_cube(t, _unit_areas(t))), "d_m", "area")


@query(
    S.with_(*S.SPACE_CHAIN)
    + """SELECT parent, count(*) FILTER (gg = '<0')::BIGINT AS neg,
         count(*) FILTER (gg <> '<0')::BIGINT AS pos,
         CASE WHEN count(gg) > 0 THEN round(count(*) FILTER (gg = '<0')::DOUBLE / count(gg), 6) END AS pct
         FROM rolled GROUP BY 1"""
)
def enrichment_share(t: Tables) -> DataFrame:
    return rounded(A.enrichment(_rolled(_cube(t, _unit_areas(t))), "parent"), "pct")


@query(
    S.with_(*S.SPACE_CHAIN)
    + """, q AS (SELECT parent, round(quantile_cont(d_m::DOUBLE, 0.25), 6) AS q1,
           round(quantile_cont(d_m::DOUBLE, 0.75), 6) AS q3,
           round(quantile_cont(d_m::DOUBLE, 0.75) - quantile_cont(d_m::DOUBLE, 0.25), 6) AS iqr
         FROM rolled GROUP BY 1)
         SELECT area, d_m, parent, gg, q1, q3, iqr FROM rolled JOIN q USING (parent) WHERE d_m > -100"""
)
def outlier_filter(t: Tables) -> DataFrame:
    """Areas above a fixed change with the quartiles of their parent."""
    rolled = durable_table(_rolled(_cube(t, _unit_areas(t))))
    return rounded(M.outliers(rolled, ["parent"], "d_m", above=-100), "q1", "q3", "iqr")


@query(
    S.with_(*S.SPACE_CHAIN)
    + """, s AS (SELECT tt, area, CASE WHEN count(d_m) = count(*) THEN sum(d_m)::BIGINT END AS d_m
                 FROM area_changes GROUP BY 1, 2)
         SELECT tt, area, d_m, sign, rank FROM (
           SELECT *, row_number() OVER (PARTITION BY sign, tt ORDER BY abs(d_m) DESC, area)::INTEGER AS rank
           FROM (SELECT *, CASE WHEN d_m > 0 THEN 'Gain' ELSE 'Loss' END AS sign FROM s WHERE d_m <> 0))
         WHERE rank <= 10"""
)
def topk_gain_loss(t: Tables) -> DataFrame:
    from ..functions.values import strict_sum

    totals = A.cube_changes(_cube(t, _unit_areas(t))).groupBy("tt", "area").agg(strict_sum("d_m").alias("d_m"))
    return top_k_signed(totals, "d_m", 10, ["tt"], "area")


@query(
    S.with_(*S.SPACE_CHAIN)
    + """SELECT area, y1, y2, m2, (w * h)::DOUBLE AS size, round(m2::DOUBLE / (w * h * 1000), 6) AS density
         FROM area_levels JOIN suppliers ON area = name"""
)
def density_level(t: Tables) -> DataFrame:
    levels = A.cube_levels(_cube(t, _unit_areas(t)))
    sizes = supplier_layer(t).select(F.col("name").alias("area"), area_of("rings").alias("size"))
    joined = join_on(levels.drop("m1"), sizes, ["area"], null_safe=False)
    return rounded(A.density(joined, "m2", "size"), "density")


def _area_profile(t: Tables, areas: DataFrame) -> DataFrame:
    inside = areas.where(F.col("area") != "").select("unit", "area")
    joined = join_on(part_profile(t), inside, ["unit"], null_safe=False)
    return M.weighted_means(joined, ["area"], PROFILE, "pop")


@query(
    S.with_(S.PARTS, S.SUPPLIERS, S.HITS, S.AREA_DICT, S.PROFILE, S.AREA_PROFILE)
    + """SELECT area, round(singd, 6) AS singd, round(semd, 6) AS semd, round("row", 6) AS "row",
         round(income, 4) AS income, round(apt, 6) AS apt FROM area_profile"""
)
def weighted_mean(t: Tables) -> DataFrame:
    means = _area_profile(t, _unit_areas(t))
    return rounded(means, "singd", "semd", "row", "apt").withColumn("income", F.round("income", 4))


@query(
    S.with_(S.L, S.PARTS, S.PROFILE)
    + """SELECT p.*, c."group", c.d_m, (w * h)::DOUBLE AS size FROM profile p
         LEFT JOIN (SELECT "group", unit,
           (coalesce(sum(value) FILTER (yr = 2001), 0) - coalesce(sum(value) FILTER (yr = 1995), 0))::BIGINT AS d_m
           FROM P GROUP BY 1, 2) c USING (unit)
         LEFT JOIN parts ON parts.id = p.unit"""
)
def unit_profile_change(t: Tables) -> DataFrame:
    change = G.first_last_change(part_panel(t), 1995, 2001).select("group", "unit", "d_m")
    sizes = part_layer(t).select(F.col("id").alias("unit"), area_of("rings").alias("size"))
    joined = join_on(part_profile(t), change, ["unit"], "left", null_safe=False)
    return join_on(joined, sizes, ["unit"], "left", null_safe=False)


@query(
    S.with_(S.L, *S.NEXT, S.PARTS)
    + """SELECT parts.id AS unit, (w * h)::DOUBLE AS size, "group", y1, y2, (coalesce(m2, 0) - coalesce(m1, 0))::BIGINT AS d_m
         FROM parts LEFT JOIN pv ON unit = parts.id"""
)
def layer_yearly_change(t: Tables) -> DataFrame:
    """Every polygon of the layer with its changes from period to period; polygons without any stay."""
    sizes = part_layer(t).select(F.col("id").alias("unit"), area_of("rings").alias("size"))
    change = C.change_class(pair_values(stored(part_panel(t)))).select("unit", "group", "y1", "y2", "d_m")
    joined = join_on(sizes, change, ["unit"], "left", null_safe=False)
    return joined.withColumn("d_m", F.coalesce("d_m", F.lit(0)))


def _model_table(t: Tables) -> DataFrame:
    areas = _area_table(t)
    layer = supplier_layer(t).select(F.col("name").alias("area"), area_of("rings").alias("size"))
    cube = _cube(t, areas)
    levels = A.cube_levels(cube)
    latest = cube.agg(F.max("y2").alias("y")).scalar()
    last = levels.where(F.col("y2") == latest).select("area", F.col("m2").alias("level"))
    return M.model_table(_rolled(cube), layer, _area_profile(t, areas), last, "area")


@query(
    S.with_(*S.SPACE_CHAIN, S.PROFILE, S.AREA_PROFILE, S.MODEL)
    + """SELECT area, d_m, parent, gg, size, round(income, 4) AS income, level, round(singd, 6) AS singd,
         round(semd, 6) AS semd, round("row", 6) AS "row", round(apt, 6) AS apt FROM model"""
)
def model_table(t: Tables) -> DataFrame:
    table = rounded(_model_table(t), "singd", "semd", "row", "apt")
    return table.withColumn("income", F.round("income", 4))


def _fitted(t: Tables) -> DataFrame:
    table = _model_table(t).select(
        (F.col("d_m") / 1000).alias("y"),
        F.col("size").alias("area"),
        "income", "singd", "semd", "row", "apt",
    )
    return M.ols_table(M.growth_regression(table, "y"), M.MODEL_TERMS, table)


def _estimates_sql() -> str:
    """Least squares by orthogonalising the terms one after the other and substituting back."""

    def z(c: str) -> str:
        return f"(({c}) - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"

    def on(a: str, u: str) -> str:
        return f"sum({a} * {u}) OVER () / sum({u} * {u}) OVER ()"

    ctes = [
        f"""z AS (SELECT d_m / 1000.0::DOUBLE AS y, {z('size')} AS x1, {z('income')} AS x2,
            {z('singd')} + {z('semd')} AS x3, {z('"row"')} + {z('apt')} AS x4 FROM model)""",
        """r AS (SELECT * FROM z WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL
            AND x3 IS NOT NULL AND x4 IS NOT NULL)""",
        "c AS (SELECT *, y - avg(y) OVER () AS v, x1 - avg(x1) OVER () AS u1, x2 - avg(x2) OVER () AS c2, "
        "x3 - avg(x3) OVER () AS c3, x4 - avg(x4) OVER () AS c4 FROM r)",
        f"o2 AS (SELECT *, c2 - u1 * ({on('c2', 'u1')}) AS u2 FROM c)",
        f"o3 AS (SELECT *, c3 - u1 * ({on('c3', 'u1')}) - u2 * ({on('c3', 'u2')}) AS u3 FROM o2)",
        f"o4 AS (SELECT *, c4 - u1 * ({on('c4', 'u1')}) - u2 * ({on('c4', 'u2')}) - u3 * ({on('c4', 'u3')}) AS u4 FROM o3)",
        "k AS (SELECT count(*)::BIGINT AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, "
        "avg(x4) AS m4, sum(v * v) AS syy, "
        + ", ".join(
            f"sum({a} * u{i}) / sum(u{i} * u{i}) AS {a}_{i}"
            for i in range(1, 5)
            for a in ("v", *[f"c{j}" for j in range(i + 1, 5)])
        )
        + ", "
        + ", ".join(f"sum(u{i} * u{i}) AS s{i}" for i in range(1, 5))
        + " FROM o4)",
        "b4 AS (SELECT *, v_4 AS e4, v_3 - c4_3 * v_4 AS e3 FROM k)",
        "b2 AS (SELECT *, v_2 - c3_2 * e3 - c4_2 * e4 AS e2 FROM b4)",
        "b AS (SELECT *, v_1 - c2_1 * e2 - c3_1 * e3 - c4_1 * e4 AS e1 FROM b2)",
        # rows of the inverse of the unit triangular matrix that turns u into c
        "w AS (SELECT *, -c2_1 AS w12, -c3_2 AS w23, -c4_3 AS w34, c2_1 * c3_2 - c3_1 AS w13, "
        "c3_2 * c4_3 - c4_2 AS w24, c2_1 * c4_2 + c3_1 * c4_3 - c4_1 - c2_1 * c3_2 * c4_3 AS w14, "
        "(v_1 ** 2 * s1 + v_2 ** 2 * s2 + v_3 ** 2 * s3 + v_4 ** 2 * s4) AS explained FROM b)",
        "h AS (SELECT *, (syy - explained) / (n - 5) AS s2e, m1 AS h1, m2 + w12 * m1 AS h2, m3 + w13 * m1 + w23 * m2 AS h3, "
        "m4 + w14 * m1 + w24 * m2 + w34 * m3 AS h4 FROM w)",
        """terms AS (SELECT unnest(['area', 'income', 'singd_semd', 'row_apt', '(Intercept)']) AS term,
            unnest([e1, e2, e3, e4, my - e1 * m1 - e2 * m2 - e3 * m3 - e4 * m4]) AS estimate,
            unnest([sqrt(s2e * (1 / s1 + w12 ** 2 / s2 + w13 ** 2 / s3 + w14 ** 2 / s4)),
                    sqrt(s2e * (1 / s2 + w23 ** 2 / s3 + w24 ** 2 / s4)), sqrt(s2e * (1 / s3 + w34 ** 2 / s4)),
                    sqrt(s2e / s4), sqrt(s2e * (1.0 / n + h1 ** 2 / s1 + h2 ** 2 / s2 + h3 ** 2 / s3 + h4 ** 2 / s4))]) AS std_error,
            n, explained / syy AS r2 FROM h)""",
    ]
    return S.with_(*S.SPACE_CHAIN, S.PROFILE, S.AREA_PROFILE, S.MODEL, *ctes)


@query(
    _estimates_sql().replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", degrees AS (SELECT n - 5 AS v FROM terms), {S.t_quantile('degrees')}
         SELECT term, round(estimate, 6) AS estimate, round(std_error, 6) AS std_error,
         round(estimate / std_error, 6) AS t_value, n, round(r2, 6) AS r2,
         round(1 - (1 - r2) * (n - 1) / (n - 5), 6) AS r2_adj,
         round(estimate - t * std_error, 5) AS ci_low, round(estimate + t * std_error, 5) AS ci_high,
         round(1 - {S.t_within('abs(estimate / std_error)', 'v')}, 6) AS p_value FROM terms JOIN quantiles ON v = n - 5"""
)
def ols_coefficients(t: Tables) -> DataFrame:
    """Regression of area change (thousands) on standardised size, income and shares."""
    table = _fitted(t).withColumn("t_value", F.col("estimate") / F.col("std_error"))
    wide = table.withColumns({c: F.round(c, 5) for c in ("ci_low", "ci_high")})
    return rounded(wide, "estimate", "std_error", "t_value", "r2", "r2_adj", "p_value")


@query(_estimates_sql() + "SELECT term, round(estimate, 6) AS estimate, n, round(r2, 6) AS r2 FROM terms")
def ols_estimates(t: Tables) -> DataFrame:
    """Estimates and fit of the same regression."""
    return rounded(_fitted(t).select("term", "estimate", "n", "r2"), "estimate", "r2")


_LONG = """, long AS (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, {x} AS value, d_m / 1000.0::DOUBLE AS y FROM model"
    for v, x in [
        ("size", "size"), ("income", "income / 1000"), ("singd", "singd"), ("semd", "semd"),
        ("row", '"row"'), ("apt", "apt"),
    ]
) + ")"


@query(
    S.with_(*S.SPACE_CHAIN, S.PROFILE, S.AREA_PROFILE, S.MODEL)
    + _LONG
    + """
        SELECT variable, round(regr_slope(y, value), 6) AS slope, round(regr_intercept(y, value), 6) AS intercept,
        round(regr_r2(y, value), 6) AS r2, regr_count(y, value)::BIGINT AS n,
        round(regr_avgx(y, value), 6) AS mean_x, round(regr_sxx(y, value), 6) AS sxx,
        round(sqrt((regr_syy(y, value) - regr_sxy(y, value) ** 2 / regr_sxx(y, value))
              / (regr_count(y, value) - 2)), 6) AS resid_error
        FROM long GROUP BY 1"""
)
def regr_by_variable(t: Tables) -> DataFrame:
    fit = M.regr_by(_model_long(t), "variable", "y", "value")
    return rounded(fit, "slope", "intercept", "r2", "mean_x", "sxx", "resid_error")


def _model_long(t: Tables) -> DataFrame:
    table = _model_table(t).select(
        (F.col("d_m") / 1000).alias("y"),
        "size", (F.col("income") / 1000).alias("income"), "singd", "semd", "row", "apt",
    )
    return table.unpivot(["y"], ["size", "income", "singd", "semd", "row", "apt"], "variable", "value")


@query(
    S.with_(*S.SPACE_CHAIN, S.PROFILE, S.AREA_PROFILE, S.MODEL).replace("WITH ", "WITH RECURSIVE ", 1)
    + _LONG
    + f""", fits AS (SELECT variable, regr_slope(y, value) AS b, regr_intercept(y, value) AS a, regr_count(y, value)::BIGINT - 2 AS v,
          regr_avgx(y, value) AS mean, regr_sxx(y, value) AS sxx,
          sqrt((regr_syy(y, value) - regr_sxy(y, value) ** 2 / regr_sxx(y, value)) / (regr_count(y, value) - 2)) AS s,
          min(value) FILTER (y IS NOT NULL) AS x1, max(value) FILTER (y IS NOT NULL) AS x2 FROM long GROUP BY 1),
        {S.t_quantile('fits')},
        grid AS (SELECT *, x1 + (x2 - x1) * k / 20.0::DOUBLE AS x FROM fits JOIN quantiles USING (v), range(21) r(k))
        SELECT variable, round(x, 6) AS x, round(a + b * x, 5) AS fit,
               round(a + b * x - t * s * sqrt(1.0 / (v + 2) + (x - mean) ** 2 / sxx), 5) AS low,
               round(a + b * x + t * s * sqrt(1.0 / (v + 2) + (x - mean) ** 2 / sxx), 5) AS high FROM grid"""
)
def confidence_bands(t: Tables) -> DataFrame:
    """Fitted lines of area change on each variable with their 95 % bands."""
    band = M.confidence_band(_model_long(t), "variable", "y", "value", points=21)
    return band.select("variable", F.round("x", 6).alias("x"), *[F.round(c, 5).alias(c) for c in ("fit", "low", "high")])
