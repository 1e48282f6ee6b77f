"""The library's inputs built from the star-schema tables: panels, dictionaries, layers.

Every frame is a plan over the whole tables of a scale-factor folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import rectangle
from ..operators.pairs import as_panel
from ..operators.scale import durable_table, join_on


# Column types of the tables: a declared schema spares the read a look into the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        df = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df


def order_panel(t: Tables, value: Column | None = None, where: Column | None = None) -> DataFrame:
    """Orders per customer and year: group = region, unit = customer.

    Orders are counted per customer and year first; names are looked up for counted rows only.
    """
    orders = t.orders if where is None else t.orders.where(where)
    counts = orders.groupBy(
        F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("yr")
    ).agg((F.count(F.lit(1)) if value is None else value).alias("value"))
    homes = customer_dictionary(t).select("unit", F.col("region").alias("group"))
    return as_panel(counts.join(homes, "unit"), "unit", "group", "yr", "value")


def stored(panel: DataFrame) -> DataFrame:
    """The panel as a written table, as an ingest step leaves it: its calendar and its pairs
    are then read from the panel and not counted from the raw rows twice."""
    return durable_table(panel)


def order_panel_null(t: Tables) -> DataFrame:
    """As order_panel, with the value 5 missing."""
    return order_panel(t, F.nullif(F.count(F.lit(1)), F.lit(5)))


def order_panel_zero(t: Tables) -> DataFrame:
    """As order_panel, one less, so that zeros occur."""
    return order_panel(t, F.count(F.lit(1)) - 1)


def customer_dictionary(t: Tables) -> DataFrame:
    """unit, area (nation), segment, region."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("area"), F.col("r_name").alias("region")
    )
    return t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("unit"), "area", F.col("c_mktsegment").alias("segment"), "region"
    )


def part_panel(t: Tables) -> DataFrame:
    """Quantity shipped per part and year: group = part type, unit = part."""
    sums = t.lineitem.groupBy(
        F.col("l_partkey").alias("unit"), F.year("l_shipdate").alias("yr")
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("value"))
    kinds = t.part.select(F.col("p_partkey").alias("unit"), F.col("p_type").alias("group"))
    return as_panel(sums.join(kinds, "unit"), "unit", "group", "yr", "value")


def part_layer(t: Tables, *more: Column) -> DataFrame:
    """One rectangle per part on a strip 700 wide that grows with the number of parts, with
    ``more`` columns of the part."""
    box = rectangle(
        "p_partkey % 100 * 7", "floor(p_partkey / 100) * 5", "p_size % 6 + 1", "p_size % 4 + 1"
    )
    return t.part.select(F.col("p_partkey").alias("id"), box.alias("rings"), *more)


def supplier_layer(t: Tables) -> DataFrame:
    """One area per supplier on the same strip, ten side by side; some touch, some overlap."""
    box = rectangle(
        "s_suppkey % 10 * 70", "floor(s_suppkey / 10) * 10", "60 + s_suppkey % 3 * 10", "8 + s_suppkey % 4"
    )
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_suppkey").alias("ord"),
        box.alias("rings"),
    )


def supplier_grid(t: Tables) -> DataFrame:
    """A gapless grid of unit squares, one per supplier, grouped by nation."""
    square = rectangle("s_suppkey % 10", "floor(s_suppkey / 10)", "1", "1")
    return t.supplier.select(F.col("s_nationkey").alias("nation"), square.alias("rings"))


def brick_wall(t: Tables) -> DataFrame:
    """A gapless wall of one brick per customer, grouped by nation: rows of sixty bricks, one, two or
    three wide from row to row, so that neighbours in different rows seldom share vertices."""
    brick = rectangle("c_custkey % 60 * wide", "floor(c_custkey / 60)", "wide", "1")
    rows = t.customer.withColumn("wide", F.expr("floor(c_custkey / 60) % 3 + 1"))
    return rows.select(F.col("c_nationkey").alias("nation"), brick.alias("rings"))


def part_corners(t: Tables) -> DataFrame:
    """The lower left corner of every part's rectangle, as coordinates of a point feature."""
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.expr("p_partkey % 100 * 7").alias("lon"),
        F.expr("floor(p_partkey / 100) * 5").alias("lat"),
    )


def order_bridge(t: Tables) -> DataFrame:
    """Many-to-many link unit - postcode with coordinates; one postcode is missing."""
    return t.orders.select(
        F.col("o_custkey").cast("string").alias("unit"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("postcode"),
        F.col("o_orderstatus").alias("csd"),
        F.year("o_orderdate").alias("lat"),
        F.nullif(F.month("o_orderdate"), F.lit(12)).alias("lon"),
    )


def postcode_cities(t: Tables) -> DataFrame:
    """postcode, city; the missing postcode has a city, one postcode has none."""
    codes = t.orders.select(
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("postcode")
    ).distinct()
    return codes.where(F.col("postcode").isNull() | (F.col("postcode") != "5-LOW")).select(
        "postcode", F.concat(F.lit("City "), F.coalesce("postcode", F.lit("none"))).alias("city")
    )


def profile_files(t: Tables) -> DataFrame:
    """The part profile as long files (bucket, content) of a thousand parts with a header line each.

    Counts are text; the apartments come in three terms, one term is not wanted. Every fiftieth part has
    a line that stops after three cells, every seventieth a line with a year that is no number.
    """
    terms = {
        "Population, 2016": F.col("pop"),
        "Single-detached house": F.col("singd"),
        "Semi-detached house": F.col("semd"),
        "Row house": F.col("row"),
        "Apartment in a building that has five or more storeys": F.col("apt"),
        "Apartment or flat in a duplex": F.col("pop"),
        "Apartment in a building that has fewer than five storeys": F.lit(1),
        "Median total income in 2015 among recipients ($)": F.col("income"),
        "Births": F.col("pop"),
    }
    unit = F.col("unit").cast("string")

    def row(term: str, value: Column) -> Column:
        cells = ["2016", unit, "1", "2", "a", "b", "0", "c", f'"{term}"', "9", "n", F.coalesce(value.cast("string"), F.lit("..")), "3", "4"]
        return F.concat_ws(",", *[c if isinstance(c, Column) else F.lit(c) for c in cells])

    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(*[row(term, value) for term, value in terms.items()]),
        F.when(F.col("unit") % 50 == 0, F.array(F.concat(F.lit("2016,"), unit, F.lit(",1")))).otherwise(none),
        F.when(F.col("unit") % 70 == 0, F.array(F.concat(F.lit("year,"), unit, F.lit(",1,2,a,b,0,c,Births,9,n,5,3,4")))).otherwise(none),
    )
    text = part_profile(t).select(F.floor(F.col("unit") / 1000).alias("bucket"), F.array_join(lines, "\n").alias("lines"))
    header = ",".join(f"c{i}" for i in range(14))
    return text.groupBy("bucket").agg(
        F.concat(F.lit(header + "\n"), F.array_join(F.collect_list("lines"), "\n")).alias("content")
    )


def holed_layer(t: Tables) -> DataFrame:
    """id, name and rings of frames around the parts' rectangles; those of even size have an island in
    their hole and a second part far away."""
    size = {"x": "p_partkey % 100 * 7", "y": "floor(p_partkey / 100) * 5", "w": "p_size % 6 + 1", "h": "p_size % 4 + 1"}
    one = t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size", *[F.expr(e).alias(k) for k, e in size.items()]
    )
    frame = F.concat(rectangle("x - 1", "y - 1", "w + 2", "h + 2"), rectangle("x", "y", "w", "h"))
    more = F.concat(rectangle("x + 0.25", "y + 0.25", "0.5", "0.5"), rectangle("x + 9000", "y", "2", "2"))
    none = F.filter(more, lambda r: F.lit(False))
    return one.select("id", "name", F.concat(frame, F.when(F.col("p_size") % 2 == 0, more).otherwise(none)).alias("rings"))


def part_profile(t: Tables) -> DataFrame:
    """Profile of a part: pop, housing counts by line flags, income from its price in cents."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def n(cond: Column) -> Column:
        return F.count(F.when(cond, F.lit(1)))

    lines = t.lineitem.groupBy(F.col("l_partkey").alias("unit")).agg(
        F.count(F.lit(1)).alias("pop"),
        n((flag == "A") & (status == "F")).alias("singd"),
        n((flag == "A") & (status == "O")).alias("semd"),
        n(flag == "N").alias("row"),
        n(flag == "R").alias("apt"),
    )
    price = t.part.select(
        F.col("p_partkey").alias("unit"),
        F.nullif(F.round(F.col("p_retailprice") * 100).cast("bigint"), F.lit(90000)).alias("income"),
    )
    return join_on(lines, price, ["unit"], null_safe=False)
