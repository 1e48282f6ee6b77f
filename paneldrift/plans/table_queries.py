"""Queries on sources, dictionaries, profiles, text, reshaping, statistics and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.bins import cut
from ..functions.values import safe_int
from ..operators import checks as K
from ..operators import dictionary as D
from ..operators import reshape as R
from ..operators import stats as M
from ..operators.classes import lump_rare as lump
from ..operators.growth import first_last_change as ends_change
from ..operators.profile import profile_wide
from ..operators.profile import row_shares as shares_of_row
from ..operators.scale import durable_table, join_on, ordered_gaps as gaps_in_order, run_folder
from ..sources.panels import parse_long, parse_transposed, read_transposed_panel
from . import sql as S
from .bindings import (
    Tables,
    customer_dictionary,
    holed_layer,
    order_bridge,
    order_panel,
    order_panel_null,
    part_panel,
    part_profile,
    postcode_cities,
    profile_files,
)
from ..functions.geometry import polygon_area, sql_ring_turn
from ..sources.tables import read_checked_profile, read_csv, read_polygons, write_geojson, write_table
from .registry import query, rounded

UNITS_PER_FILE = 1000


def transposed_files(t: Tables) -> DataFrame:
    """The NULL variant of the order panel written as transposed files of at most 1000 units.

    The first file of a region and year has the city header, the others continue it.
    """
    p = order_panel_null(t).withColumn("chunk", F.floor(F.col("unit") / UNITS_PER_FILE))
    blocks = p.groupBy("yr", "group", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("unit", "value"))).alias("cells"),
        F.sum("value").alias("subtotal"),
    )
    cities = blocks.groupBy("yr", "group").agg(
        F.min("chunk").alias("first"), F.sum("subtotal").alias("total")
    )
    files = join_on(blocks, cities, ["yr", "group"])
    main = F.col("chunk") == F.col("first")
    units = F.transform("cells", lambda c: c["unit"].cast("string"))
    values = F.transform("cells", lambda c: F.coalesce(c["value"].cast("string"), F.lit("")))
    year_cell = F.concat(F.col("yr"), F.lit(" Census"))
    head = F.when(main, F.array(year_cell, F.concat(F.col("group"), F.lit(" CMA")))).otherwise(
        F.array(year_cell)
    )
    # the label is quoted in main files and blank in those that continue them
    label = F.when(
        main, F.array(F.lit('"Population, all"'), F.col("total").cast("string"))
    ).otherwise(F.array(F.lit("")))
    name = F.concat(
        "group", F.lit("_"), F.lpad(F.col("chunk").cast("string"), 10, "0"),
        F.when(main, ".csv").otherwise("_v2.csv"),
    )
    written = files.select(
        F.concat(F.col("yr"), F.lit(" data")).alias("folder"),
        name.alias("file"),
        F.concat_ws(
            "\n",
            F.array_join(F.concat(head, units), ","),
            F.array_join(F.concat(label, values), ","),
        ).alias("content"),
    )
    return durable_table(written)


CITY = """upper(left("group", 1)) || lower(substr(split_part("group", ' ', 1), 2))"""


@query(S.with_(S.PN) + f'SELECT {CITY} AS "group", unit, yr, value FROM P')
def panel_ingest_transposed(t: Tables) -> DataFrame:
    return parse_transposed(transposed_files(t))[0]


@query(S.with_(S.PN) + f'SELECT {CITY} AS "group", yr, sum(value)::BIGINT AS pop FROM P GROUP BY 1, 2')
def panel_ingest_totals(t: Tables) -> DataFrame:
    return parse_transposed(transposed_files(t))[1]


@query(S.with_(S.PN) + f'SELECT {CITY} AS "group", unit, yr, value FROM P')
def panel_files(t: Tables) -> DataFrame:
    """The transposed files written into folders and read back by ranges of their wide lines."""
    root = f"{run_folder(t.spark)}/{uuid.uuid4().hex}"
    transposed_files(t).write.partitionBy("folder", "file").text(root)
    return read_transposed_panel(t.spark, root, "partitions")[0]


def _long_rows(t: Tables) -> DataFrame:
    p = order_panel_null(t)
    prefix = F.when(F.col("group") == "AFRICA", "35").otherwise("59")
    units = p.select(
        F.concat(prefix, F.lpad(F.col("unit").cast("string"), 10, "0"), F.lit(" (00000)")).alias("geo"),
        F.coalesce(F.col("value").cast("string"), F.lit("..")).alias("pop"),
        "yr",
    )
    cities = p.groupBy("group", "yr").agg(F.sum("value").cast("string").alias("pop"))
    return units.unionByName(
        cities.select(F.concat("group", F.lit(" CMA")).alias("geo"), "pop", "yr")
    )


@query(
    S.with_(S.PN)
    + f"""SELECT CASE WHEN "group" = 'AFRICA' THEN 'Africa' ELSE 'Elsewhere' END AS "group",
          CASE WHEN "group" = 'AFRICA' THEN 350000000000 ELSE 590000000000 END + unit AS unit, yr,
          value, 'unit' AS kind FROM P
          UNION ALL SELECT {CITY}, NULL, yr, sum(value)::BIGINT, 'total' FROM P GROUP BY "group", yr"""
)
def panel_ingest_long(t: Tables) -> DataFrame:
    panel, totals = parse_long(_long_rows(t), F.col("yr"), {"35": "Africa"}, "Elsewhere")
    return R.union_tagged(
        {"unit": panel, "total": totals.withColumnRenamed("pop", "value")}, "kind"
    ).select("group", "unit", "yr", "value", "kind")


@query(
    """SELECT user_id AS unit, pop, income,
       CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL AND a3 IS NOT NULL THEN a1 + a2 + a3 END AS apt
       FROM (SELECT user_id,
         max(v) FILTER (event_type = 'view') AS pop, max(v) FILTER (event_type = 'purchase') AS income,
         max(v) FILTER (event_type = 'click') AS a1, max(v) FILTER (event_type = 'error') AS a2,
         max(v) FILTER (event_type = 'signup') AS a3
       FROM (SELECT user_id, event_type,
               CASE WHEN count(*) % 7 = 0 THEN NULL ELSE count(*)::BIGINT END AS v
             FROM events GROUP BY 1, 2) GROUP BY 1)"""
)
def profile_pivot(t: Tables) -> DataFrame:
    """Events counted per user and type as a long profile; some counts are not published ('..')."""
    n = F.count(F.lit(1))
    long = t.events.groupBy(
        F.col("user_id").alias("unit"), F.col("event_type").alias("term")
    ).agg(F.when(n % 7 == 0, "..").otherwise(n.cast("string")).alias("value"))
    terms = {"view": "pop", "purchase": "income", "click": "apt1", "error": "apt2", "signup": "apt3"}
    return profile_wide(long, terms, sums={"apt": ["apt1", "apt2", "apt3"]})


def _checked_profile(t: Tables) -> tuple[DataFrame, DataFrame]:
    root = f"{run_folder(t.spark)}/{uuid.uuid4().hex}"
    profile_files(t).write.partitionBy("bucket").text(root)
    units = t.part.where("p_size > 5").select(F.col("p_partkey").alias("unit"))
    return read_checked_profile(t.spark, root, units)


@query(
    S.with_(S.PROFILE)
    + """SELECT 2016 AS year, unit, pop, singd, semd, "row", apt + pop + 1 AS apt, income
         FROM profile JOIN part ON unit = p_partkey WHERE p_size > 5"""
)
def profile_files_read(t: Tables) -> DataFrame:
    """Long profile files with broken rows among them: the good rows of the wanted units."""
    return _checked_profile(t)[0]


@query(
    S.with_(S.PROFILE)
    + """SELECT 'cells' AS reason, '2016,' || unit || ',1' AS record FROM profile WHERE unit % 50 = 0
         UNION ALL SELECT 'year', 'year,' || unit FROM profile WHERE unit % 70 = 0"""
)
def profile_quarantine(t: Tables) -> DataFrame:
    """The broken rows of the same files, with what is wrong."""
    return _checked_profile(t)[1]


@query(
    S.with_(S.PARTS)
    + """SELECT id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 4 ELSE 2 END AS n_rings,
         CASE WHEN p_size % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
         ((w + 2) * (h + 2) - w * h + CASE WHEN p_size % 2 = 0 THEN 4.25 ELSE 0 END)::DOUBLE AS area,
         CASE WHEN p_size % 2 = 0 THEN 4.25 ELSE 0 END + (w + 2) * (h + 2) - w * h::DOUBLE AS turned
         FROM parts JOIN part ON id = p_partkey"""
)
def geojson_round_trip(t: Tables) -> DataFrame:
    """Frames with holes, islands and distant parts written as GeoJSON lines and read back.

    ``turned`` adds up the rings' signed areas: outer rings count, holes subtract by their direction."""
    root = f"{run_folder(t.spark)}/{uuid.uuid4().hex}"
    write_geojson(holed_layer(t), root)
    kind = F.get_json_object("value", "$.geometry.type").alias("kind")
    written = t.spark.read.text(root).select(F.get_json_object("value", "$.properties.id").alias("id"), kind)
    layer = read_polygons(t.spark, root, "geojson").select("properties.id", "properties.name", "rings")
    turn = F.expr(f"aggregate(rings, 0D, (total, r) -> total + {sql_ring_turn('r')} / 2)")
    return join_on(layer, written, ["id"]).select(
        F.col("id").cast("bigint").alias("id"), "name", "kind", F.size("rings").alias("n_rings"),
        polygon_area("rings").alias("area"), turn.alias("turned"),
    )


@query(
    """SELECT n_name AS nation, """
    + ", ".join(
        f"sum(CASE WHEN o_orderpriority = '{p}' THEN 1 END)::BIGINT AS \"{p}\""
        for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    )
    + """ FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def pivot_found(t: Tables) -> DataFrame:
    """Orders by nation and priority, one column for each priority that the orders have."""
    return R.pivot_found(_priorities(t), ["nation"], "o_orderpriority", "one")


def _priorities(t: Tables) -> DataFrame:
    rows = join_on(
        t.orders.select(F.col("o_custkey").alias("unit"), "o_orderpriority"), customer_dictionary(t), ["unit"]
    )
    return rows.select(F.col("area").alias("nation"), F.col("region"), "o_orderpriority", F.lit(1).cast("bigint").alias("one"))


@query(
    """WITH wide AS (SELECT r_name AS region, n_name, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END)::BIGINT AS a,
         sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END)::BIGINT AS b
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey WHERE o_custkey % 3 = 0 GROUP BY 1, 2)
       SELECT region, CASE WHEN count(a) = count(*) THEN sum(a)::BIGINT END AS "1-URGENT",
         CASE WHEN count(b) = count(*) THEN sum(b)::BIGINT END AS "2-HIGH" FROM wide GROUP BY 1"""
)
def sum_by_pattern(t: Tables) -> DataFrame:
    """Columns found by a pivot, chosen by a pattern of their names and summed by region."""
    rows = join_on(
        t.orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("unit"), "o_orderpriority"), customer_dictionary(t), ["unit"]
    ).withColumn("one", F.lit(1).cast("bigint"))
    wide = R.pivot_found(rows, ["region", "area"], "o_orderpriority", "one")
    return R.sum_matching(R.select_matching(wide, ["region"], "URGENT|HIGH"), ["region"], "URGENT|HIGH")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) .*t$')")
def regex_filter(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name").where(F.col("p_name").rlike("^(red|blue) .*t$"))


@query(
    S.with_(S.BRIDGE)
    + """SELECT unit::VARCHAR AS unit, postcode, csd, lat, lon FROM bridge
         WHERE postcode IS NOT NULL AND lon IS NOT NULL"""
)
def drop_na_any(t: Tables) -> DataFrame:
    return order_bridge(t).na.drop()


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS status,
       CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 END AS status_ord FROM orders"""
)
def recode_labels(t: Tables) -> DataFrame:
    status = T.recode("o_orderstatus", {"F": "Finished", "O": "Open"})
    return t.orders.select(
        "o_orderkey",
        status.alias("status"),
        T.category_position(status, ["Open", "Finished"]).alias("status_ord"),
    )


@query(
    S.with_(S.PN, S.DICT)
    + 'SELECT "group", unit, yr, value, area, segment, region FROM P LEFT JOIN dict USING (unit)'
)
def left_join_dict(t: Tables) -> DataFrame:
    return join_on(
        order_panel_null(t), customer_dictionary(t), ["unit"], "left", null_safe=False
    )


HIERARCHY = """base AS (SELECT unit, region AS cma, area || ' ' || left(segment, 1) AS csd,
  segment AS ccsd, region AS cd FROM dict)"""


def _hierarchy(t: Tables) -> DataFrame:
    d = customer_dictionary(t)
    return d.select(
        "unit",
        F.col("region").alias("cma"),
        F.concat("area", F.lit(" "), F.substring("segment", 1, 1)).alias("csd"),
        F.col("segment").alias("ccsd"),
        F.col("region").alias("cd"),
    )


@query(
    S.with_(S.DICT, HIERARCHY, S.BRIDGE, S.CITIES)
    + """SELECT base.unit, cma, base.csd, ccsd, cd, b.postcode, b.csd AS csd_bridge, lat, lon, city
         FROM base LEFT JOIN bridge b ON b.unit = base.unit
         LEFT JOIN cities c ON c.postcode IS NOT DISTINCT FROM b.postcode"""
)
def bridge_join_m2n(t: Tables) -> DataFrame:
    return D.bridge_join(_hierarchy(t), D.clean_bridge(order_bridge(t)), postcode_cities(t))


@query(
    S.with_(S.DICT, HIERARCHY, S.BRIDGE, S.CITIES, S.P)
    + r""", known AS (SELECT unit, cma, regexp_replace(csd, '\s[0-9A-Z]$', '', 'g') AS csd,
            regexp_replace(ccsd, '\s[0-9A-Z]$', '', 'g') AS ccsd, cd FROM base
            WHERE unit IN (SELECT unit FROM P)),
         linked AS (SELECT k.*, b.postcode, lat, lon, coalesce(city, k.csd) AS name
           FROM known k LEFT JOIN bridge b ON b.unit = k.unit
           LEFT JOIN cities c ON c.postcode IS NOT DISTINCT FROM b.postcode),
         frequent AS (SELECT name FROM linked WHERE csd = 'NATION_3' GROUP BY 1 HAVING count(*) > 110)
         SELECT unit, cma, csd, ccsd, cd, postcode, lat, lon,
         CASE WHEN csd <> 'NATION_3' THEN csd WHEN name IN (SELECT name FROM frequent) THEN name
              ELSE 'NATION_3' END AS csd_alt FROM linked"""
)
def dictionary_build(t: Tables) -> DataFrame:
    return D.build_dictionary(
        _hierarchy(t), order_bridge(t), postcode_cities(t), order_panel(t), "NATION_3", 110
    )


@query(
    """SELECT unit, flag, status, n FROM (
         SELECT *, row_number() OVER (PARTITION BY unit ORDER BY n DESC, flag NULLS LAST, status NULLS LAST) AS rn
         FROM (SELECT l_partkey AS unit, nullif(l_returnflag, 'A') AS flag, l_linestatus AS status,
               count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2, 3)) WHERE rn = 1"""
)
def mode_per_unit(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_partkey").alias("unit"),
        F.nullif(F.col("l_returnflag"), F.lit("A")).alias("flag"),
        F.col("l_linestatus").alias("status"),
    )
    return D.most_common(rows, "unit", ["flag", "status"])


@query(
    """SELECT c_custkey, c_mktsegment FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"""
)
def semi_units(t: Tables) -> DataFrame:
    buyers = t.orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("c_custkey")
    )
    return join_on(
        t.customer.select("c_custkey", "c_mktsegment"), buyers, ["c_custkey"], "left_semi", False
    )


@query(
    S.with_(S.P)
    + "SELECT unit FROM P WHERE yr = 1995 EXCEPT SELECT unit FROM P WHERE yr = 2001"
)
def except_units(t: Tables) -> DataFrame:
    p = order_panel(t)
    return R.except_keys(p.where("yr = 1995"), p.where("yr = 2001"), ["unit"])


@query(
    """SELECT tt, "group", segment, n, yr FROM (
       SELECT 'customers' AS tt, r_name AS "group", c_mktsegment AS segment, count(*)::BIGINT AS n, NULL::INTEGER AS yr
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2, 3
       UNION ALL SELECT 'orders', r_name, NULL, count(*)::BIGINT, year(o_orderdate)::INTEGER
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 2, 5)"""
)
def union_by_name(t: Tables) -> DataFrame:
    customers = (
        customer_dictionary(t)
        .groupBy(F.col("region").alias("group"), "segment")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    orders = order_panel(t).groupBy("yr", "group").agg(F.sum("value").alias("n"))
    return R.union_tagged({"customers": customers, "orders": orders})


@query(
    """SELECT l_partkey, sum(l_quantity) FILTER (l_returnflag = 'A')::BIGINT AS "A",
       sum(l_quantity) FILTER (l_returnflag = 'N')::BIGINT AS "N",
       sum(l_quantity) FILTER (l_returnflag = 'R')::BIGINT AS "R" FROM lineitem GROUP BY 1"""
)
def pivot_labels(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_partkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q")
    )
    return R.pivot_values(lines, ["l_partkey"], "l_returnflag", "q", ["A", "N", "R"])


@query(
    """SELECT p_partkey AS unit, 'say "' || p_name || '", ' || p_brand AS label, p_size::INTEGER AS size,
       CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS kind FROM part"""
)
def csv_round_trip(t: Tables) -> DataFrame:
    """Parts with quotes and commas in a column and missing values, written as CSV and read back."""
    label = F.concat(F.lit('say "'), "p_name", F.lit('", '), "p_brand")
    kind = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    parts = t.part.select(
        F.col("p_partkey").alias("unit"), label.alias("label"), F.col("p_size").alias("size"), kind.alias("kind")
    )
    path = f"{run_folder(t.spark)}/csv-{uuid.uuid4().hex}"
    write_table(parts, path, "csv")
    return read_csv(t.spark, path, "unit bigint, label string, size int, kind string")


YEARS = list(range(1995, 2002))


def known_years(p: DataFrame) -> DataFrame:
    """The panel; a year without a column in the pivot raises an error instead of being dropped."""
    other = F.raise_error(F.concat(F.lit("no column for year "), F.col("yr").cast("string")))
    return p.withColumn("yr", F.when(F.col("yr").isin(YEARS), F.col("yr")).otherwise(other))


@query(
    S.with_(S.L)
    + 'SELECT "group", unit, '
    + ", ".join(f"sum(value) FILTER (yr = {y})::BIGINT AS y{y}" for y in YEARS)
    + " FROM P GROUP BY 1, 2"
)
def pivot_years(t: Tables) -> DataFrame:
    return R.pivot_values(known_years(part_panel(t)), ["group", "unit"], "yr", "value", YEARS, prefix="y")


@query(
    S.with_(S.PROFILE)
    + " UNION ALL ".join(
        f"""SELECT unit, '{c}' AS measure, "{c}"::BIGINT AS value FROM profile"""
        for c in ("singd", "semd", "row", "apt", "income")
    )
)
def unpivot_measures(t: Tables) -> DataFrame:
    return part_profile(t).unpivot(
        ["unit"], ["singd", "semd", "row", "apt", "income"], "measure", "value"
    )


@query(
    r"""SELECT p_partkey, regexp_replace(p_name || ' T', '\s[0-9A-Z]$', '', 'g') AS no_suffix,
       regexp_replace(p_name || ' (' || p_size || ')', '\s\(.*\)', '', 'g') AS no_brackets,
       split_part(p_name, ' ', 2) AS second,
       upper(left(p_name, 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) AS city FROM part"""
)
def string_clean(t: Tables) -> DataFrame:
    size = F.concat(F.lit(" ("), F.col("p_size"), F.lit(")"))
    return t.part.select(
        "p_partkey",
        T.strip_suffix(F.concat("p_name", F.lit(" T"))).alias("no_suffix"),
        T.strip_parenthetical(F.concat("p_name", size)).alias("no_brackets"),
        T.token("p_name", 2).alias("second"),
        T.title_token(F.upper("p_name")).alias("city"),
    )


@query(
    """SELECT p_partkey, rtrim(array_to_string(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')[1:3], ' ')) AS first3,
       p_name AS whole FROM part"""
)
def string_first_tokens(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey",
        T.first_tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 3).alias("first3"),
        T.first_tokens("p_name", 3).alias("whole"),
    )


@query(
    r"""SELECT o_orderkey, regexp_replace(lower(o_orderpriority || ' ' || o_orderstatus), '\s', '_', 'g') AS slug FROM orders"""
)
def string_slug(t: Tables) -> DataFrame:
    label = F.concat_ws(" ", "o_orderpriority", "o_orderstatus")
    return t.orders.select("o_orderkey", T.slug(label).alias("slug"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice)::BIGINT END AS price FROM orders"""
)
def string_number_clean(t: Tables) -> DataFrame:
    """Prices written with thousands commas and a footnote, or as 'n/a', read back as numbers."""
    note = F.concat(F.format_number(F.round("o_totalprice"), 0), F.lit("[note 2]"))
    written = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(note)
    return t.orders.select("o_orderkey", T.plain_number(written).alias("price"))


@query(
    """SELECT status AS city, year(o_orderdate)::INTEGER AS year, count(*)::BIGINT * 1000 AS pop
       FROM orders JOIN (VALUES ('F', 'Finished'), ('O', 'Open')) s(code, status) ON o_orderstatus = code GROUP BY 1, 2
       UNION ALL SELECT status, 1, NULL FROM (VALUES ('Finished'), ('Open')) s(status)"""
)
def external_stack(t: Tables) -> DataFrame:
    """Two tables of yearly totals written as '1,234,000[note]', cleaned and stacked."""

    def table(status: str) -> DataFrame:
        years = t.orders.where(F.col("o_orderstatus") == status).groupBy(F.year("o_orderdate").alias("year"))
        rows = years.agg(F.concat(F.format_number(F.count(F.lit(1)) * 1000, 0), F.lit("[3]")).alias("total"))
        total = t.region.limit(1).select(F.lit(1).alias("year"), F.lit("unknown[1]").alias("total"))
        return rows.union(total).withColumn("cma", F.lit("1"))

    return R.stack_external({"Finished": table("F"), "Open": table("O")}, "total")


@query(
    """SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole, NULL::BIGINT AS word,
       CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS maybe FROM orders"""
)
def safe_cast(t: Tables) -> DataFrame:
    maybe = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.col("o_orderkey"))).otherwise("..")
    return t.orders.select(
        "o_orderkey",
        safe_int(F.col("o_totalprice").cast("string")).alias("whole"),
        safe_int("o_orderpriority").alias("word"),
        safe_int(maybe).alias("maybe"),
    )


SPEND = S.order_panel("sum(floor(o_totalprice))")


@query(
    S.with_(SPEND)
    + """, c AS (SELECT "group", unit, (coalesce(sum(value) FILTER (yr = 2001), 0)
           - coalesce(sum(value) FILTER (yr = 1995), 0))::BIGINT AS d_m FROM P GROUP BY 1, 2)
         SELECT *, CASE WHEN d_m > -12000 AND d_m <= 0 THEN '<0' WHEN d_m > 0 AND d_m <= 5000 THEN '0-5K'
                        WHEN d_m > 5000 AND d_m <= 60000 THEN '>5K' END AS gg FROM c"""
)
def cut_bins(t: Tables) -> DataFrame:
    spend = order_panel(t, F.sum(F.floor("o_totalprice")))
    change = ends_change(spend, 1995, 2001).select("group", "unit", "d_m")
    return change.withColumn("gg", cut("d_m", (-12000, 0, 5000, 60000), ("<0", "0-5K", ">5K")))


@query(
    """SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size,
       round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice FROM part"""
)
def zscore(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(M.zscore(parts, ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


@query(
    S.with_(S.PROFILE)
    + "SELECT unit, "
    + ", ".join(
        f'round("{c}"::DOUBLE / nullif(singd + semd + "row" + apt, 0), 6) AS "{c}"'
        for c in ("singd", "semd", "row", "apt")
    )
    + " FROM profile"
)
def row_shares(t: Tables) -> DataFrame:
    kinds = ["singd", "semd", "row", "apt"]
    return rounded(shares_of_row(part_profile(t).select("unit", *kinds), kinds), *kinds)


@query(
    S.with_(S.PN)
    + """SELECT "group", unit, string_agg(yr::VARCHAR, ', ' ORDER BY yr) AS years
         FROM P WHERE value IS NOT NULL GROUP BY 1, 2"""
)
def collect_string(t: Tables) -> DataFrame:
    """The periods a unit has a value in, as one text."""
    present = order_panel_null(t).where(F.col("value").isNotNull())
    return R.collect_string(present, ["group", "unit"], "yr", "years")


@query(
    """SELECT c_nationkey::VARCHAR || c_mktsegment AS kind, count(*)::BIGINT AS n FROM customer
       GROUP BY 1 HAVING count(*) > 10"""
)
def having_min_count(t: Tables) -> DataFrame:
    kinds = t.customer.select(F.concat("c_nationkey", "c_mktsegment").alias("kind"))
    return D.frequent_values(kinds, "kind", 10)


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(
    S.with_(S.DICT)
    + """, s AS (SELECT unit, region, nullif(segment, 'MACHINERY') AS segment FROM dict)
         SELECT *, CASE WHEN segment IS NULL THEN NULL
           WHEN count(*) OVER (PARTITION BY region, segment) >= 60 THEN segment
           ELSE 'Other (' || region || ')' END AS lumped FROM s"""
)
def lump_rare(t: Tables) -> DataFrame:
    rows = customer_dictionary(t).select(
        "unit", "region", F.nullif(F.col("segment"), F.lit("MACHINERY")).alias("segment")
    )
    other = F.concat(F.lit("Other ("), F.col("region"), F.lit(")"))
    return lump(rows, "segment", 60, ["region"], other, "lumped")


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@query(
    S.with_(S.L)
    + """SELECT "group", round(quantile_cont(value::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(value::DOUBLE, 0.75), 6) AS q3,
         round(quantile_cont(value::DOUBLE, 0.75) - quantile_cont(value::DOUBLE, 0.25), 6) AS iqr FROM P GROUP BY 1"""
)
def quantile_iqr(t: Tables) -> DataFrame:
    return rounded(M.quartiles(part_panel(t), ["group"], "value"), "q1", "q3", "iqr")


@query(
    S.with_(S.L)
    + """SELECT "group", yr, min(value) AS lowest, round(quantile_cont(value::DOUBLE, 0.25), 6) AS q1,
         round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round(avg(value), 6) AS mean,
         round(quantile_cont(value::DOUBLE, 0.75), 6) AS q3, max(value) AS highest FROM P GROUP BY 1, 2"""
)
def six_number_summary(t: Tables) -> DataFrame:
    return rounded(M.six_numbers(part_panel(t), ["group", "yr"], "value"), "mean", *QUARTILES)


@query(
    S.with_(S.L)
    + """, q AS (SELECT "group", quantile_cont(value::DOUBLE, 0.25) AS q1, quantile_cont(value::DOUBLE, 0.5) AS median,
           quantile_cont(value::DOUBLE, 0.75) AS q3 FROM P GROUP BY 1),
         r AS (SELECT P.*, q1, median, q3,
           value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM P JOIN q USING ("group"))
         SELECT "group", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
         min(value) FILTER (inside) AS whisker_low, max(value) FILTER (inside) AS whisker_high,
         count(*) FILTER (NOT inside)::BIGINT AS n_outliers FROM r GROUP BY ALL"""
)
def boxplot_stats(t: Tables) -> DataFrame:
    return rounded(M.boxplot(part_panel(t), ["group"], "value"), *QUARTILES)


@query(
    """SELECT p_partkey, p_type, row_number() OVER w::BIGINT AS rn,
       round(row_number() OVER w::DOUBLE / count(*) OVER (PARTITION BY p_type), 6) AS fraction
       FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_partkey)"""
)
def rank_fraction(t: Tables) -> DataFrame:
    parts = t.part.select("p_partkey", "p_type")
    return rounded(R.rank_fraction(parts, ["p_type"], [F.col("p_partkey").asc()]), "fraction")


@query(
    """SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (
         PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || ':7'), c_custkey) AS rn FROM customer)
       WHERE rn <= 3"""
)
def hash_sample_n(t: Tables) -> DataFrame:
    """Three customers per nation, the same on every run."""
    return R.hash_sample(t.customer.select("c_nationkey", "c_custkey"), "c_custkey", 3, ["c_nationkey"], 7)


@query(
    """SELECT o_custkey, o_orderkey, row_number() OVER w::BIGINT AS rn, o_orderkey - lag(o_orderkey) OVER w AS gap
       FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def ordered_gaps(t: Tables) -> DataFrame:
    orders = t.orders.select("o_custkey", "o_orderkey")
    return gaps_in_order(orders, ["o_custkey"], [F.col("o_orderkey").asc()], "o_orderkey")


@query(
    """SELECT a.value - b.value AS diff, count(*)::BIGINT AS n
       FROM (SELECT o_custkey, year(o_orderdate) AS yr, count(*)::BIGINT AS value FROM orders GROUP BY 1, 2) a
       LEFT JOIN (SELECT o_custkey, year(o_orderdate) AS yr, count(*)::BIGINT AS value FROM orders
                  WHERE o_orderstatus <> 'P' GROUP BY 1, 2) b USING (o_custkey, yr) GROUP BY 1"""
)
def version_diff(t: Tables) -> DataFrame:
    newer, older = order_panel(t), order_panel(t, where=F.expr("o_orderstatus <> 'P'"))
    return K.version_differences(newer, older, ["group", "unit", "yr"], "value")


@query(
    "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"
)
def check_unique_key(t: Tables) -> DataFrame:
    return K.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def check_referential(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("k"))
    return K.unknown_keys(orders, t.lineitem.select(F.col("l_orderkey").alias("k")), ["k"])


@query(
    """SELECT DISTINCT o_orderkey AS k, o_orderstatus AS name_a, l_linestatus AS name_b
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> l_linestatus"""
)
def check_agreement(t: Tables) -> DataFrame:
    a = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    b = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linestatus")
    return K.disagreements(a, b, ["k"], "o_orderstatus", "l_linestatus")


@query(
    """WITH s AS (SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1),
    u AS (SELECT n AS expected FROM s GROUP BY 1 ORDER BY count(*) DESC, n LIMIT 1)
    SELECT l_orderkey, n, expected FROM s, u WHERE n <> expected"""
)
def check_block_size(t: Tables) -> DataFrame:
    return K.block_sizes(t.lineitem, "l_orderkey")


@query(
    S.with_(S.P)
    + """SELECT a.n_rows, b.n_units FROM (SELECT count(*)::BIGINT AS n_rows FROM P) a,
         (SELECT count(DISTINCT c_custkey)::BIGINT AS n_units FROM customer) b WHERE n_rows <> n_units"""
)
def check_row_count(t: Tables) -> DataFrame:
    return K.row_count_gap(order_panel(t), t.customer, "c_custkey")


@query(S.with_(*S.SPACE) + "SELECT unit, parent, area FROM dict WHERE area = ''")
def check_unassigned(t: Tables) -> DataFrame:
    from .space_queries import _unit_areas

    return K.unassigned(_unit_areas(t), "area")
