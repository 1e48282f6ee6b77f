"""Shared pieces of the oracle SQL, written independently of the operators' plans."""

from __future__ import annotations


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def order_panel(value: str = "count(*)", where: str = "TRUE", name: str = "P") -> str:
    return f"""{name} AS (
  SELECT r_name AS "group", o_custkey AS unit, year(o_orderdate)::INTEGER AS yr,
         ({value})::BIGINT AS value
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE {where} GROUP BY 1, 2, 3)"""


P = order_panel()
PN = order_panel("nullif(count(*), 5)")
PZ = order_panel("count(*) - 1")

L = """P AS (
  SELECT p_type AS "group", l_partkey AS unit, year(l_shipdate)::INTEGER AS yr,
         sum(l_quantity)::BIGINT AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""

DICT = """dict AS (
  SELECT c_custkey AS unit, n_name AS area, c_mktsegment AS segment, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""

DICT_WIDE = """dict AS (
  SELECT c_custkey AS unit, n_name AS area, c_mktsegment AS segment, r_name AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT -1 - n_nationkey, n_name || ' (new)', NULL, NULL FROM nation)"""

PAIRS_NEXT = """pairs AS (
  SELECT y1, y2 FROM (SELECT yr AS y1, lead(yr) OVER (ORDER BY yr) AS y2
                      FROM (SELECT DISTINCT yr FROM P)) WHERE y2 IS NOT NULL)"""
PAIRS_ALL = """pairs AS (
  SELECT a.yr AS y1, b.yr AS y2 FROM (SELECT DISTINCT yr FROM P) a
  JOIN (SELECT DISTINCT yr FROM P) b ON a.yr < b.yr)"""

PV = """pv AS (
  SELECT k."group", k.unit, k.y1, k.y2, a.value AS m1, b.value AS m2,
         CASE WHEN a.value = 0 AND b.value > 0 THEN 'inf'::DOUBLE
              WHEN a.value = 0 THEN NULL
              ELSE b.value::DOUBLE / a.value - 1 END AS pct
  FROM (SELECT DISTINCT "group", unit, y1, y2 FROM P JOIN pairs ON yr = y1 OR yr = y2) k
  LEFT JOIN P a ON a."group" = k."group" AND a.unit = k.unit AND a.yr = k.y1
  LEFT JOIN P b ON b."group" = k."group" AND b.unit = k.unit AND b.yr = k.y2)"""

NEXT = [PAIRS_NEXT, PV]
ALL = [PAIRS_ALL, PV]

CELLS = """cells AS (
  SELECT "group", y1, y2, m1 IS NULL AS m1_missing, m2 IS NULL AS m2_missing,
         count(*)::BIGINT AS n FROM pv GROUP BY ALL)"""

WITHIN = """within_unit AS (
  SELECT *, m2 - m1 AS d, CASE WHEN m2 - m1 < 0 THEN 'Loss' ELSE 'Gain' END AS tt
  FROM pv WHERE m1 IS NOT NULL AND m2 IS NOT NULL)"""

CLASSES = """classes AS (
  SELECT *, CASE WHEN m1 IS NOT NULL AND m2 IS NULL THEN 'Lost DA'
                 WHEN m1 IS NULL AND m2 IS NOT NULL THEN 'New DA'
                 WHEN m1 > m2 THEN 'Lost Density'
                 WHEN m1 <= m2 THEN 'New Density' END AS tt,
         coalesce(m2, 0) - coalesce(m1, 0) AS d_m FROM pv)"""


def class_area(lump_min: int) -> str:
    return f"""class_area AS (
  SELECT c.*, area, segment, region,
         CASE WHEN area IS NULL THEN NULL
              WHEN count(*) OVER (PARTITION BY "group", y1, area) >= {lump_min} THEN area
              ELSE 'Other (' || "group" || ')' END AS area_lump
  FROM classes c LEFT JOIN dict USING (unit))"""


def net_by(source: str, keys: str, total: bool = False) -> str:
    parts = [
        f"""SELECT {keys}, 'Net Density' AS tt, sum(CASE WHEN tt IN ('New Density', 'Lost Density')
            THEN d_m ELSE 0 END)::BIGINT AS d_m FROM {source} GROUP BY {keys}""",
        f"""SELECT {keys}, 'Net DAs' AS tt, sum(CASE WHEN tt IN ('New DA', 'Lost DA')
            THEN d_m ELSE 0 END)::BIGINT AS d_m FROM {source} GROUP BY {keys}""",
    ]
    if total:
        parts.append(
            f"SELECT {keys}, 'Net Total' AS tt, sum(d_m)::BIGINT AS d_m FROM {source} GROUP BY {keys}"
        )
    return " UNION ALL ".join(parts)


BRIDGE = """bridge AS (
  SELECT o_custkey AS unit, nullif(o_orderpriority, '4-NOT SPECIFIED') AS postcode,
         o_orderstatus AS csd, year(o_orderdate)::INTEGER AS lat,
         nullif(month(o_orderdate), 12)::INTEGER AS lon FROM orders)"""
CITIES = """cities AS (
  SELECT DISTINCT nullif(o_orderpriority, '4-NOT SPECIFIED') AS postcode,
         'City ' || coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'none') AS city
  FROM orders WHERE o_orderpriority <> '5-LOW')"""

PARTS = """parts AS (
  SELECT p_partkey AS id, (p_partkey % 100) * 7 AS x, (p_partkey // 100) * 5 AS y,
         p_size % 6 + 1 AS w, p_size % 4 + 1 AS h FROM part)"""
SUPPLIERS = """suppliers AS (
  SELECT s_suppkey AS id, s_name AS name, (s_suppkey % 10) * 70 AS x, (s_suppkey // 10) * 10 AS y,
         60 + s_suppkey % 3 * 10 AS w, 8 + s_suppkey % 4 AS h FROM supplier)"""
HITS = """hits AS (
  SELECT p.id AS a_id, s.id AS b_id, s.name FROM parts p JOIN suppliers s
  ON p.x <= s.x + s.w AND s.x <= p.x + p.w AND p.y <= s.y + s.h AND s.y <= p.y + p.h)"""
AREA_DICT = """dict AS (
  SELECT p_partkey AS unit, p_brand AS parent, coalesce(last_area, '') AS area
  FROM part LEFT JOIN (SELECT a_id, arg_max(name, b_id) AS last_area FROM hits GROUP BY 1)
  ON p_partkey = a_id)"""
SPACE = [PARTS, SUPPLIERS, HITS, AREA_DICT]

PER_UNIT_NET = f"unit_net AS ({net_by('classes', 'unit, y1, y2')})"
AREA_CHANGES = """area_changes AS (
  SELECT y1, y2, tt, area,
         CASE WHEN count(d_m) = count(*) THEN sum(d_m)::BIGINT END AS d_m
  FROM unit_net RIGHT JOIN dict USING (unit) GROUP BY 1, 2, 3, 4)"""
AREA_LEVELS = """area_levels AS (
  SELECT area, y1, y2, sum(coalesce(m1, 0))::BIGINT AS m1, sum(coalesce(m2, 0))::BIGINT AS m2
  FROM pv RIGHT JOIN dict USING (unit) GROUP BY 1, 2, 3)"""
ROLLUP_BREAKS = (-12000, 0, 250, 60000)
ROLLUP = f"""rolled AS (
  SELECT area, d_m, parent,
         CASE WHEN d_m > {ROLLUP_BREAKS[0]} AND d_m <= {ROLLUP_BREAKS[1]} THEN '<0'
              WHEN d_m > {ROLLUP_BREAKS[1]} AND d_m <= {ROLLUP_BREAKS[2]} THEN '0-5K'
              WHEN d_m > {ROLLUP_BREAKS[2]} AND d_m <= {ROLLUP_BREAKS[3]} THEN '>5K' END AS gg
  FROM (SELECT area, CASE WHEN count(d) = count(*) THEN sum(d)::BIGINT END AS d_m
        FROM (SELECT tt, area, CASE WHEN count(d_m) = count(*) THEN sum(d_m) END AS d
              FROM area_changes GROUP BY 1, 2) GROUP BY 1)
  LEFT JOIN (SELECT area, CASE WHEN min(parent) = 'Brand#1' THEN 'Old Brand' ELSE min(parent) END
             AS parent FROM dict GROUP BY 1) USING (area))"""
SPACE_CHAIN = [L, *NEXT, CLASSES, *SPACE, PER_UNIT_NET, AREA_CHANGES, AREA_LEVELS, ROLLUP]

PROFILE = """profile AS (
  SELECT l_partkey AS unit, count(*)::BIGINT AS pop,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F')::BIGINT AS singd,
         count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'O')::BIGINT AS semd,
         count(*) FILTER (l_returnflag = 'N')::BIGINT AS "row",
         count(*) FILTER (l_returnflag = 'R')::BIGINT AS apt,
         max(nullif(round(p_retailprice * 100)::BIGINT, 90000)) AS income
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def weighted(column: str) -> str:
    kept = f"CASE WHEN {column} IS NOT NULL THEN pop END"
    return f"sum({column} * pop)::DOUBLE / nullif(sum({kept}), 0)"


AREA_PROFILE = "area_profile AS (SELECT area, " + ", ".join(
    f'{weighted(c)} AS {c}' for c in ("singd", "semd", '"row"', "income", "apt")
) + " FROM profile JOIN dict USING (unit) WHERE area <> '' GROUP BY 1)"
MODEL = """model AS (
  SELECT area, d_m, parent, gg, (w * h)::DOUBLE AS size, income, m2 AS level,
         singd / nullif(t, 0) AS singd, semd / nullif(t, 0) AS semd,
         "row" / nullif(t, 0) AS "row", apt / nullif(t, 0) AS apt
  FROM (SELECT *, singd + semd + "row" + apt AS t FROM rolled
        LEFT JOIN (SELECT name AS area, w, h FROM suppliers) USING (area)
        LEFT JOIN area_profile USING (area)
        LEFT JOIN (SELECT area, m2 FROM area_levels WHERE y2 = (SELECT max(yr) FROM P)) USING (area)))"""


def t_within(t: str, v: str) -> str:
    """P(-t < T < t) for whole degrees of freedom: closed forms with gamma functions."""
    q = f"({v} / ({v} + {t} * {t}))"
    sine = f"({t} / sqrt({v} + {t} * {t}))"
    even = f"""list_sum(list_transform(range(0, CAST(({v} - 2) // 2 + 1 AS BIGINT)),
      lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE)) / sqrt(pi()) * pow({q}, k)))"""
    odd = f"""coalesce(list_sum(list_transform(range(0, CAST(({v} - 3) // 2 + 1 AS BIGINT)),
      lambda k: exp(lgamma(k + 1.0::DOUBLE) - lgamma(k + 1.5::DOUBLE)) * sqrt(pi()) / 2 * pow({q}, k))), 0)"""
    return (
        f"CASE WHEN {v} % 2 = 0 THEN {sine} * {even} "
        f"ELSE 2 / pi() * (atan2({t}, sqrt({v}::DOUBLE)) + {sine} * sqrt({q}) * {odd}) END"
    )


def t_quantile(source: str, level: float = 0.95) -> str:
    """CTE quantiles (v, t): bisection for every number of degrees of freedom v of a CTE."""
    middle = "((lo + hi) / 2)"
    return f"""bisected AS (
  SELECT DISTINCT v, 0::DOUBLE AS lo, 700::DOUBLE AS hi, 0 AS step FROM {source}
  UNION ALL SELECT v, CASE WHEN below THEN middle ELSE lo END, CASE WHEN below THEN hi ELSE middle END, step + 1
  FROM (SELECT *, {middle} AS middle, {t_within(middle, 'v')} < {level} AS below FROM bisected WHERE step < 64)),
quantiles AS (SELECT v, lo AS t FROM bisected WHERE step = 64)"""
