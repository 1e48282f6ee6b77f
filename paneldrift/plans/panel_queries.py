"""Queries on the order panel: presence, growth, decomposition, classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import classes as C
from ..operators import growth as G
from ..operators import pairs as P
from ..operators.dictionary import clean_bridge, mean_coordinates
from ..operators.reshape import category_order as ordered_categories
from ..operators.scale import join_on
from ..functions.text import recode
from ..operators.areas import area_changes, area_levels as levels_by_area, rank_areas
from ..functions.text import category_position
from ..functions.values import strict_avg, strict_sum
from . import sql as S
from .bindings import (
    Tables,
    customer_dictionary,
    order_bridge,
    order_panel,
    order_panel_null,
    order_panel_zero,
    stored,
)
from .registry import query, rounded

LUMP_MIN = 55


@query(S.with_(S.P) + 'SELECT "group", yr, count(*)::BIGINT AS n FROM P GROUP BY 1, 2')
def count_by_group_year(t: Tables) -> DataFrame:
    return P.units_per_period(order_panel(t))


@query(S.with_(S.P) + 'SELECT "group", count(DISTINCT unit)::BIGINT AS n_units FROM P GROUP BY 1')
def count_distinct_units(t: Tables) -> DataFrame:
    return P.distinct_units(order_panel(t))


@query(
    S.with_(S.PN)
    + """SELECT "group", unit, CASE WHEN count(value) = count(*) THEN sum(value)::BIGINT END AS strict,
         sum(value)::BIGINT AS plain FROM P GROUP BY 1, 2"""
)
def strict_sum_null(t: Tables) -> DataFrame:
    return (
        order_panel_null(t)
        .groupBy("group", "unit")
        .agg(strict_sum("value").alias("strict"), F.sum("value").alias("plain"))
    )


@query(
    S.with_(S.BRIDGE)
    + """SELECT unit, CASE WHEN count(lat) = count(*) THEN round(avg(lat), 6) END AS lat,
         CASE WHEN count(lon) = count(*) THEN round(avg(lon), 6) END AS lon,
         round(avg(lat), 6) AS lat_known, round(avg(lon), 6) AS lon_known FROM bridge GROUP BY 1"""
)
def centroid_mean(t: Tables) -> DataFrame:
    means = clean_bridge(order_bridge(t)).groupBy("unit").agg(
        *[strict_avg(c).alias(c) for c in ("lat", "lon")],
        *[F.avg(c).alias(f"{c}_known") for c in ("lat", "lon")],
    )
    return rounded(means, "lat", "lon", "lat_known", "lon_known")


@query(
    S.with_(S.PN, S.BRIDGE)
    + """SELECT "group", unit, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon
         FROM (SELECT DISTINCT "group", unit FROM P WHERE yr IN (1995, 2001)) a
         JOIN bridge USING (unit)
         WHERE NOT EXISTS (SELECT 1 FROM P b WHERE b."group" = a."group" AND b.unit = a.unit
                           AND b.yr = 2001 AND b.value IS NOT NULL)
         GROUP BY 1, 2 HAVING avg(lat) IS NOT NULL AND avg(lon) IS NOT NULL"""
)
def anti_lost_units(t: Tables) -> DataFrame:
    lost = P.lost_units(order_panel_null(t), 1995, 2001)
    where = mean_coordinates(clean_bridge(order_bridge(t)), "unit", ["lat", "lon"], True).na.drop()
    return rounded(join_on(lost, where, ["unit"], null_safe=False), "lat", "lon")


@query(
    S.with_(S.PN, *S.ALL, S.CELLS)
    + """SELECT *, sum(n) OVER (PARTITION BY "group", y1, y2)::BIGINT AS tot,
         round(n::DOUBLE / sum(n) OVER (PARTITION BY "group", y1, y2), 6) AS pct FROM cells"""
)
def pairwise_presence(t: Tables) -> DataFrame:
    return rounded(P.presence(stored(order_panel_null(t))), "pct")


@query(
    S.with_(S.PN, *S.ALL)
    + """SELECT "group", y1, y2, count(*) FILTER (m1 IS NOT NULL AND m2 IS NOT NULL)::BIGINT AS both,
         count(*)::BIGINT AS tot,
         round(count(*) FILTER (m1 IS NOT NULL AND m2 IS NOT NULL)::DOUBLE / count(*), 6) AS jaccard
         FROM pv GROUP BY 1, 2, 3"""
)
def jaccard_pairs(t: Tables) -> DataFrame:
    return rounded(P.jaccard(P.presence(stored(order_panel_null(t)))), "jaccard")


@query(
    S.with_(S.PN, *S.NEXT)
    + """, c AS (SELECT "group", y1, y2,
           count(*) FILTER (m1 IS NOT NULL AND m2 IS NULL)::BIGINT AS lost,
           count(*) FILTER (m1 IS NULL AND m2 IS NOT NULL)::BIGINT AS gained
         FROM pv GROUP BY 1, 2, 3)
         SELECT *, CASE WHEN lost > 0 THEN round(gained::DOUBLE / lost, 6) END AS ratio FROM c"""
)
def churn_gain_lost(t: Tables) -> DataFrame:
    return rounded(P.churn(P.presence(stored(order_panel_null(t)), "consecutive")), "ratio")


PV_COLUMNS = 'SELECT "group", unit, y1, y2, m1, m2, round(pct, 6) AS pct FROM pv'


@query(S.with_(S.PN, *S.ALL) + PV_COLUMNS)
def pairwise_change(t: Tables) -> DataFrame:
    return rounded(P.pair_values(stored(order_panel_null(t)), "all"), "pct")


@query(
    S.with_(S.PZ, *S.NEXT)
    + 'SELECT "group", unit, y1, y2, m1, m2, CASE WHEN isinf(pct) THEN pct ELSE round(pct, 6) END AS pct FROM pv'
)
def consecutive_pairs(t: Tables) -> DataFrame:
    return rounded(P.pair_values(stored(order_panel_zero(t))), "pct")


@query(
    S.with_(S.PZ, *S.NEXT)
    + """SELECT "group", y1, y2, sum(m1)::BIGINT AS m1, sum(m2)::BIGINT AS m2,
         round(sum(m2)::DOUBLE / sum(m1) - 1, 6) AS growth
         FROM pv WHERE pct IS NOT NULL GROUP BY 1, 2, 3"""
)
def growth_like_for_like(t: Tables) -> DataFrame:
    return rounded(G.growth_like_for_like(P.pair_values(stored(order_panel_zero(t)))), "growth")


LAGGED = """totals AS (SELECT "group", yr, sum(value)::BIGINT AS pop FROM P GROUP BY 1, 2),
lagged AS (SELECT "group", lag(yr) OVER w AS y1, yr AS y2, lag(pop) OVER w AS m1, pop AS m2
           FROM totals WINDOW w AS (PARTITION BY "group" ORDER BY yr)),
actual AS (SELECT *, m2::DOUBLE / m1 - 1 AS growth FROM lagged WHERE y1 IS NOT NULL)"""


@query(
    S.with_(S.P, LAGGED)
    + 'SELECT "group", y1, y2, m1, m2, round(growth, 6) AS growth FROM actual'
)
def growth_lag(t: Tables) -> DataFrame:
    return rounded(G.growth_aggregate(G.period_totals(order_panel(t))), "growth")


@query(
    S.with_(S.P, *S.NEXT, LAGGED)
    + """, lfl AS (SELECT "group", y1, y2, sum(m2)::DOUBLE / sum(m1) - 1 AS growth FROM pv
                   WHERE pct IS NOT NULL GROUP BY 1, 2, 3)
         SELECT "group", y1, y2, 'act' AS tt, round(growth, 6) AS growth FROM actual
         UNION ALL
         SELECT a."group", a.y1, a.y2, 'DA', round(b.growth, 6) FROM actual a
         LEFT JOIN lfl b ON a."group" = b."group" AND a.y1 = b.y1 AND a.y2 = b.y2"""
)
def growth_compare(t: Tables) -> DataFrame:
    p = stored(order_panel(t))
    actual = G.growth_aggregate(G.period_totals(p))
    return rounded(
        G.growth_compare(actual, G.growth_like_for_like(P.pair_values(p))), "growth"
    )


@query(
    S.with_(S.P, *S.ALL)
    + """SELECT "group", y1, y2, CASE WHEN count(m1) = count(*) THEN sum(m1)::BIGINT END AS m1,
         CASE WHEN count(m2) = count(*) THEN sum(m2)::BIGINT END AS m2,
         round(CASE WHEN count(m1) = count(*) AND count(m2) = count(*)
               THEN sum(m2)::DOUBLE / sum(m1) - 1 END, 6) AS growth FROM pv
         WHERE m1 IS NOT NULL GROUP BY 1, 2, 3"""
)
def growth_pairs_total(t: Tables) -> DataFrame:
    """Growth of all pairs over the units known in the first period."""
    pv = P.pair_values(stored(order_panel(t)), "all").where(F.col("m1").isNotNull())
    return rounded(G.growth_pairs_total(pv), "growth")


SERIES = """series AS (
  SELECT 'reported' AS tt, r_name AS "group", year(o_orderdate)::INTEGER AS yr, count(*)::BIGINT AS pop
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3
  UNION ALL SELECT 'summed', "group", yr, sum(value)::BIGINT FROM P GROUP BY 1, 2, 3
  UNION ALL SELECT 'external', 'World', year(o_orderdate)::INTEGER, count(*)::BIGINT FROM orders GROUP BY 1, 2, 3)"""
CLOSED = "o_orderstatus <> 'P'"
P_CLOSED = S.order_panel(where=CLOSED)


def _reported(t: Tables) -> DataFrame:
    """Reported totals per region and year: orders are counted per customer before they meet names."""
    homes = customer_dictionary(t).select("unit", F.col("region").alias("group"))
    counted = t.orders.groupBy(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("yr")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.join(homes, "unit").groupBy("group", "yr").agg(F.sum("n").alias("pop"))


def _world(t: Tables) -> DataFrame:
    years = t.orders.groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("pop"))
    return years.withColumn("group", F.lit("World"))


@query(
    S.with_(P_CLOSED, SERIES)
    + """, i AS (SELECT *, round(pop * 100.0::DOUBLE / first(pop) OVER (PARTITION BY tt, "group" ORDER BY yr), 6) AS idx FROM series)
         SELECT "group", yr, tt, 'pop' AS measure, pop::DOUBLE AS value FROM i
         UNION ALL SELECT "group", yr, tt, 'idx', idx FROM i"""
)
def index_to_base(t: Tables) -> DataFrame:
    stacked = G.stacked_index(
        {
            "reported": _reported(t),
            "summed": G.period_totals(order_panel(t, where=F.expr(CLOSED))),
            "external": _world(t),
        }
    )
    return rounded(stacked, "value")


@query(
    S.with_(P_CLOSED, SERIES)
    + """, i AS (SELECT *, round(pop * 100.0::DOUBLE / first(pop) OVER (PARTITION BY tt, "group" ORDER BY yr), 6) AS idx FROM series
         WHERE tt <> 'summed')
         SELECT "group", yr, tt, 'Population (000)' AS measure, round(pop / 1000.0::DOUBLE, 6) AS value FROM i WHERE tt = 'reported'
         UNION ALL SELECT "group", yr, tt, 'Index', idx FROM i"""
)
def index_external(t: Tables) -> DataFrame:
    """Regional totals in thousands, and their indices beside that of an external series."""
    stacked = G.stacked_index({"reported": _reported(t), "external": _world(t)}, index_only=["external"], scale=1000.0)
    return rounded(stacked.withColumn("measure", recode("measure", {"pop": "Population (000)", "idx": "Index"})), "value")


@query(
    S.with_(P_CLOSED, SERIES)
    + """SELECT "group", yr, a.pop AS reported, b.pop AS summed, round(a.pop::DOUBLE / b.pop - 1, 6) AS err
         FROM (SELECT * FROM series WHERE tt = 'reported') a
         FULL JOIN (SELECT * FROM series WHERE tt = 'summed') b USING ("group", yr)"""
)
def reconcile_error(t: Tables) -> DataFrame:
    closed = G.period_totals(order_panel(t, where=F.expr(CLOSED)))
    return rounded(G.reconcile(_reported(t), closed), "err")


def _cohort_sql(base: str) -> str:
    anchor = "(SELECT min(yr) FROM P)" if base == "first" else "iyear"
    return S.with_(
        S.PN,
        """cohorts AS (SELECT "group", unit, yr AS iyear FROM P
           WHERE value IS NOT NULL AND yr < (SELECT max(yr) FROM P))""",
        """sums AS (SELECT c."group", iyear, yr, sum(coalesce(value, 0))::BIGINT AS pop
           FROM cohorts c JOIN P ON P."group" = c."group" AND P.unit = c.unit GROUP BY 1, 2, 3)""",
        """grid AS (SELECT "group", iyear, yr, coalesce(pop, 0) AS pop
           FROM (SELECT DISTINCT "group", iyear FROM cohorts) CROSS JOIN (SELECT DISTINCT yr FROM P)
           LEFT JOIN sums USING ("group", iyear, yr))""",
    ) + f"""SELECT a."group", a.iyear, a.yr, a.pop,
            CASE WHEN b.pop <> 0 THEN round(a.pop * 100.0::DOUBLE / b.pop, 6) END AS idx
            FROM grid a JOIN grid b ON a."group" = b."group" AND a.iyear = b.iyear
            AND b.yr = {anchor.replace('iyear', 'a.iyear')}"""


@query(_cohort_sql("first"))
def cohort_index(t: Tables) -> DataFrame:
    return rounded(G.cohort_index(stored(order_panel_null(t))), "idx")


@query(
    "SELECT \"group\", iyear::VARCHAR AS series, yr, pop, idx FROM (" + _cohort_sql("first") + ") UNION ALL "
    + S.with_(S.PN).replace("WITH P", "SELECT * FROM (WITH P", 1)
    + """, totals AS (SELECT "group", yr, coalesce(sum(value), 0)::BIGINT AS pop FROM P GROUP BY 1, 2)
        SELECT a."group", 'Actual' AS series, a.yr, a.pop,
               CASE WHEN b.pop <> 0 THEN round(a.pop * 100.0::DOUBLE / b.pop, 6) END AS idx
        FROM totals a JOIN totals b ON a."group" = b."group"
             AND b.yr = (SELECT min(yr) FROM totals c WHERE c."group" = a."group"))"""
)
def cohort_curves(t: Tables) -> DataFrame:
    """Cohort indices beside the index of all units."""
    return rounded(G.cohort_curves(stored(order_panel_null(t))), "idx")


@query(_cohort_sql("cohort"))
def cohort_index_own_base(t: Tables) -> DataFrame:
    return rounded(G.cohort_index(stored(order_panel_null(t)), base="cohort"), "idx")


DECOMPOSED = """parts AS (
  SELECT "group", y1, y2, CASE WHEN m1 IS NOT NULL AND m2 IS NOT NULL THEN 'Density'
         WHEN m1 IS NOT NULL THEN 'Lost DAs' ELSE 'New DAs' END AS tt,
         sum(coalesce(m2, 0) - coalesce(m1, 0))::BIGINT AS dd FROM pv GROUP BY 1, 2, 3, 4)"""


@query(
    S.with_(S.PN, *S.NEXT, DECOMPOSED)
    + '''SELECT *, sum(dd) OVER (PARTITION BY "group", y1, y2)::BIGINT AS change,
         CASE tt WHEN 'Density' THEN 1 WHEN 'New DAs' THEN 2 ELSE 3 END::INTEGER AS tt_ord FROM parts'''
)
def growth_decompose(t: Tables) -> DataFrame:
    parts = G.decompose(P.pair_values(stored(order_panel_null(t))))
    return parts.withColumn("tt_ord", category_position("tt", G.PART_ORDER))


@query(
    S.with_(S.P, *S.NEXT, DECOMPOSED)
    + """, steps AS (
           SELECT "group", 'Actual' AS tt, y2 AS yr, sum(dd) AS dd FROM parts GROUP BY 1, 2, 3
           UNION ALL SELECT "group", 'Density', y2, sum(CASE WHEN tt = 'Density' THEN dd ELSE 0 END)
           FROM parts GROUP BY 1, 2, 3
           UNION ALL SELECT "group", 'Net DAs', y2, sum(CASE WHEN tt <> 'Density' THEN dd ELSE 0 END)
           FROM parts GROUP BY 1, 2, 3
           UNION ALL SELECT "group", l, (SELECT min(yr) FROM P), 0
           FROM (SELECT DISTINCT "group" FROM P), (VALUES ('Actual'), ('Density'), ('Net DAs')) v(l)),
         base AS (SELECT "group", sum(value) AS b FROM P WHERE yr = (SELECT min(yr) FROM P) GROUP BY 1)
         SELECT "group", tt, yr, (b + sum(dd) OVER (PARTITION BY "group", tt ORDER BY yr))::BIGINT AS pop,
         CASE tt WHEN 'Density' THEN 1 WHEN 'Net DAs' THEN 2 ELSE 3 END::INTEGER AS tt_ord
         FROM steps JOIN base USING ("group")"""
)
def counterfactual_curve(t: Tables) -> DataFrame:
    p = stored(order_panel(t))
    curves = G.counterfactual(G.decompose(P.pair_values(p)), G.period_totals(p))
    return curves.withColumn("tt_ord", category_position("tt", G.CURVE_ORDER))


@query(
    S.with_(S.PN, *S.NEXT, DECOMPOSED)
    + """SELECT *, sum(dd) OVER (PARTITION BY "group", tt ORDER BY y1)::BIGINT AS cum FROM parts"""
)
def cumulative_change(t: Tables) -> DataFrame:
    parts = G.decompose(P.pair_values(stored(order_panel_null(t)))).drop("change")
    return G.cumulative(parts, ["group", "tt"], "y1", "dd", "cum")


@query(
    S.with_(S.P, *S.NEXT, S.WITHIN)
    + """, v AS (SELECT *, ln(abs(d) + 1) AS x FROM within_unit),
         e AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
         SELECT "group", y2, tt, least(floor((x - lo) / (hi - lo) * 15) + 1, 15)::BIGINT AS bin,
         count(*)::BIGINT AS n FROM v, e GROUP BY 1, 2, 3, 4"""
)
def histogram_change(t: Tables) -> DataFrame:
    from ..operators.stats import histogram

    within = C.within_unit_change(P.pair_values(stored(order_panel(t))))
    return histogram(within, ["group", "y2", "tt"], F.ln(F.abs("d") + 1), 15)


@query(
    S.with_(S.P, *S.NEXT, S.WITHIN)
    + """SELECT "group", y2, tt, sum(d)::BIGINT AS d FROM within_unit GROUP BY 1, 2, 3
         UNION ALL SELECT "group", y2, 'Net', sum(d)::BIGINT FROM within_unit GROUP BY 1, 2"""
)
def grouping_sets_net(t: Tables) -> DataFrame:
    return C.gain_loss(P.pair_values(stored(order_panel(t))))


SIGN = "CASE WHEN d < 0 THEN 'Loss' WHEN d = 0 THEN 'No Change' ELSE 'Gain' END"


@query(
    S.with_(S.P, *S.NEXT, S.WITHIN)
    + f'''SELECT *, CASE sign WHEN 'Loss' THEN 1 WHEN 'No Change' THEN 2 ELSE 3 END::INTEGER AS sign_ord FROM (
          SELECT "group", y2, {SIGN} AS sign, count(*)::BIGINT AS n FROM within_unit GROUP BY 1, 2, 3)'''
)
def count_by_sign(t: Tables) -> DataFrame:
    counts = C.sign_counts(P.pair_values(stored(order_panel(t))))
    return counts.withColumn("sign_ord", category_position("sign", C.SIGN_ORDER))


@query(
    S.with_(S.P, *S.NEXT, S.WITHIN, S.BRIDGE)
    + f"""SELECT s.*, sum(n) OVER (PARTITION BY s.unit)::BIGINT AS tot,
          round(n::DOUBLE / sum(n) OVER (PARTITION BY s.unit), 6) AS pct, lat, lon
          FROM (SELECT "group", unit, {SIGN} AS sign, count(*)::BIGINT AS n FROM within_unit GROUP BY 1, 2, 3) s
          LEFT JOIN (SELECT unit, CASE WHEN count(lat) = count(*) THEN round(avg(lat), 6) END AS lat,
                     CASE WHEN count(lon) = count(*) THEN round(avg(lon), 6) END AS lon
                     FROM bridge GROUP BY 1) USING (unit)"""
)
def sign_share_per_unit(t: Tables) -> DataFrame:
    where = mean_coordinates(clean_bridge(order_bridge(t)), "unit", ["lat", "lon"])
    shares = C.sign_share(P.pair_values(stored(order_panel(t))), where)
    return rounded(shares, "pct", "lat", "lon")


def _classified(t: Tables) -> DataFrame:
    return C.change_class_area(
        P.pair_values(stored(order_panel_null(t)), by_unit_only=True),
        customer_dictionary(t),
        "area",
        LUMP_MIN,
    )


CLASSIFIED = [S.PN, *S.NEXT, S.CLASSES, S.DICT, S.class_area(LUMP_MIN)]


@query(
    S.with_(*CLASSIFIED)
    + """SELECT "group", unit, y1, y2, m1, m2, round(pct, 6) AS pct, tt, d_m, area, segment, region,
         area_lump FROM class_area"""
)
def change_class_area(t: Tables) -> DataFrame:
    return rounded(_classified(t), "pct")


@query(S.with_(*CLASSIFIED) + S.net_by("class_area", '"group", y1, y2, area_lump'))
def net_by_area_period(t: Tables) -> DataFrame:
    return C.net_by(_classified(t), ["group", "y1", "y2", "area_lump"])


@query(
    S.with_(S.PN, *S.NEXT, S.CLASSES, S.DICT)
    + """SELECT segment, tot, row_number() OVER (ORDER BY tot DESC, segment)::BIGINT AS ord
         FROM (SELECT segment, max(tot)::BIGINT AS tot
               FROM (SELECT "group", segment, sum(CASE WHEN tt IS NOT NULL THEN d_m ELSE 0 END) AS tot
                     FROM classes LEFT JOIN dict USING (unit) GROUP BY 1, 2) GROUP BY 1)"""
)
def category_order(t: Tables) -> DataFrame:
    """Segments occur in every group: each is ordered by its largest total of a group."""
    classified = C.change_class(P.pair_values(stored(order_panel_null(t)), by_unit_only=True))
    segments = customer_dictionary(t).select("unit", "segment")
    net = C.net_by(join_on(classified, segments, ["unit"], "left"), ["group", "segment"])
    return ordered_categories(net, "segment", "d_m", within=["group"])


def _net_by_area(t: Tables) -> DataFrame:
    classified = C.change_class(P.pair_values(stored(order_panel_null(t)), by_unit_only=True))
    areas = customer_dictionary(t).select("unit", "area")
    joined = join_on(classified, areas, ["unit"], "left", null_safe=False)
    return C.net_by(joined, ["group", "area"], with_total=True)


AREA_NET = [S.PN, *S.NEXT, S.CLASSES, S.DICT, S.class_area(1)]


@query(S.with_(*AREA_NET) + S.net_by("class_area", '"group", area', total=True))
def net_by_area(t: Tables) -> DataFrame:
    return _net_by_area(t)


@query(
    S.with_(*AREA_NET, f"net AS ({S.net_by('class_area', chr(34) + 'group' + chr(34) + ', area', total=True)})")
    + """SELECT *, sum(d_m) OVER (PARTITION BY tt, "group")::BIGINT AS tot,
         CASE WHEN sum(d_m) OVER (PARTITION BY tt, "group") <> 0
         THEN round(d_m::DOUBLE / sum(d_m) OVER (PARTITION BY tt, "group"), 6) END AS pct FROM net"""
)
def share_of_total(t: Tables) -> DataFrame:
    return rounded(C.share_of_total(_net_by_area(t), "d_m", ["tt", "group"]), "pct")


@query(
    S.with_(S.PN, *S.NEXT, S.CLASSES, S.DICT)
    + "SELECT area, sum(d_m)::BIGINT AS tot FROM classes LEFT JOIN dict USING (unit) GROUP BY 1 ORDER BY 2 DESC, 1"
)
def ranked_areas(t: Tables) -> DataFrame:
    return rank_areas(P.pair_values(stored(order_panel_null(t))), customer_dictionary(t))


def _wide_dictionary(t: Tables) -> DataFrame:
    """The dictionary with one more unit, without orders, for each nation."""
    more = t.nation.select(
        (-1 - F.col("n_nationkey")).cast("bigint").alias("unit"), F.concat("n_name", F.lit(" (new)")).alias("area")
    )
    return customer_dictionary(t).unionByName(more, allowMissingColumns=True)


@query(
    S.with_(S.P, *S.NEXT, S.CLASSES, S.DICT_WIDE, S.PER_UNIT_NET, S.AREA_CHANGES)
    + "SELECT * FROM area_changes"
)
def right_join_keep_dict(t: Tables) -> DataFrame:
    classified = C.change_class(P.pair_values(stored(order_panel(t))))
    return area_changes(classified, _wide_dictionary(t))


@query(
    S.with_(S.P, *S.NEXT, S.DICT_WIDE, S.AREA_LEVELS) + "SELECT * FROM area_levels"
)
def area_levels(t: Tables) -> DataFrame:
    return levels_by_area(P.pair_values(stored(order_panel(t))), _wide_dictionary(t))


GRID = """grid AS (SELECT "group", unit, yr, value
  FROM (SELECT DISTINCT "group", unit FROM P) CROSS JOIN (SELECT DISTINCT yr FROM P)
  LEFT JOIN P USING ("group", unit, yr))"""


@query(S.with_(S.PN, GRID) + "SELECT * FROM grid")
def complete_grid(t: Tables) -> DataFrame:
    return G.complete_grid(stored(order_panel_null(t)))


@query(
    S.with_(S.PN, GRID)
    + """SELECT "group", unit, yr, coalesce(value, 0) AS value,
         coalesce(value, 0) - lag(coalesce(value, 0)) OVER (PARTITION BY "group", unit ORDER BY yr) AS delta
         FROM grid"""
)
def period_delta_grid(t: Tables) -> DataFrame:
    return G.period_delta(stored(order_panel_null(t)))


@query(
    S.with_(S.PN)
    + """, v AS (SELECT "group", unit,
           coalesce(sum(value) FILTER (yr = (SELECT min(yr) FROM P)), 0)::BIGINT AS v_first,
           coalesce(sum(value) FILTER (yr = (SELECT max(yr) FROM P)), 0)::BIGINT AS v_last
         FROM P GROUP BY 1, 2) SELECT *, v_last - v_first AS d_m FROM v"""
)
def first_last_change(t: Tables) -> DataFrame:
    return G.first_last_change(stored(order_panel_null(t)))


@query(
    S.with_(S.PN, GRID)
    + 'SELECT "group", yr, (count(*) - count(value))::BIGINT AS n_missing FROM grid GROUP BY 1, 2'
)
def missing_per_year(t: Tables) -> DataFrame:
    return G.missing_per_period(stored(order_panel_null(t)))


@query(
    S.with_(S.PN)
    + """SELECT "group", unit FROM P WHERE yr >= 1998 GROUP BY 1, 2
         HAVING count(value) = (SELECT count(DISTINCT yr) FROM P WHERE yr >= 1998)"""
)
def complete_cases(t: Tables) -> DataFrame:
    return P.complete_cases(stored(order_panel_null(t)), 1998)
