"""Typed CSV tables, profiles, polygon layers and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import RINGS_TYPE, sql_point_inside, sql_ring_edges, sql_ring_turn
from ..operators.profile import profile_wide

# The 14 columns of a long profile file, by position.
PROFILE_COLUMNS = [
    "year", "geo1", "geo2", "geo3", "gnr", "gnr2", "qc", "geo4", "tt", "mem", "notes",
    "total", "male", "female",
]
# Profile terms and their short names.
PROFILE_TERMS = {
    "Population, 2016": "pop",
    "Single-detached house": "singd",
    "Semi-detached house": "semd",
    "Row house": "row",
    "Apartment in a building that has five or more storeys": "apt1",
    "Apartment or flat in a duplex": "apt2",
    "Apartment in a building that has fewer than five storeys": "apt3",
    "Median total income in 2015 among recipients ($)": "income",
}
PROFILE_SUMS = {"apt": ["apt1", "apt2", "apt3"]}
# Column names of the unit dictionary file and their short names.
DICTIONARY_COLUMNS = {
    "DAUID,C,8": "unit",
    "PRNAME,C,100": "prov",
    "CSDNAME,C,100": "csd",
    "CCSNAME,C,100": "ccsd",
    "CDNAME,C,100": "cd",
    "CMANAME,C,100": "cma",
}


def read_csv(
    spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """CSV with an explicit schema; only ``columns`` are parsed when given."""
    df = spark.read.schema(schema).csv(path, header=True, escape='"')
    return df.select(*columns) if columns else df


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Unit dictionary (unit, cma, csd, ccsd, cd) from a file with punctuated column names."""
    types = ", ".join(
        f"`{k}` {'bigint' if v == 'unit' else 'string'}" for k, v in DICTIONARY_COLUMNS.items()
    )
    df = spark.read.schema(types).csv(path, header=True, enforceSchema=False, escape='"')
    return rename_columns(df, DICTIONARY_COLUMNS).select("unit", "cma", "csd", "ccsd", "cd")


def _profile_rows(spark: SparkSession, path: str, checked: bool) -> DataFrame:
    """The 14 columns of long profile files as text, with ``record`` = the line of a row that does not
    have 14 cells. Only a scan that is to find such rows has to parse all columns."""
    schema = ", ".join(f"{c} string" for c in PROFILE_COLUMNS)
    reader = spark.read.option("header", True).option("enforceSchema", True).option("escape", '"')
    if checked:
        reader = reader.option("mode", "PERMISSIVE").option("columnPruning", False)
        reader = reader.option("columnNameOfCorruptRecord", "record")
        schema += ", record string"
    return reader.option("recursiveFileLookup", True).schema(schema).csv(path)


def read_profile(
    spark: SparkSession,
    path: str,
    units: DataFrame,
    terms: Mapping[str, str] | None = None,
    sums: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per wanted unit from large long profiles, read as one distributed scan.

    ``sums`` adds up terms; its default belongs to the default terms. The filter on the terms is
    pushed into the parser, which then skips the other cells of unwanted rows."""
    long = _profile_rows(spark, path, checked=False)
    return _profile(long, units, terms, sums)


def _profile(
    long: DataFrame,
    units: DataFrame,
    terms: Mapping[str, str] | None,
    sums: Mapping[str, Sequence[str]] | None,
) -> DataFrame:
    wanted = terms or PROFILE_TERMS
    rows = long.where(F.col("tt").isin(list(wanted))).select(
        F.col("year").try_cast("int").alias("year"),
        F.col("geo1").try_cast("bigint").alias("unit"),
        F.col("tt").alias("term"),
        F.col("total").alias("value"),
    )
    if sums is None:
        sums = PROFILE_SUMS if terms is None else {}
    return profile_wide(rows, wanted, units, sums, ids=["year", "unit"])


def read_checked_profile(
    spark: SparkSession,
    path: str,
    units: DataFrame,
    terms: Mapping[str, str] | None = None,
    sums: Mapping[str, Sequence[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """As ``read_profile`` from the good rows only, and the bad ones: (reason, record).

    Bad are rows without 14 cells ("cells"), with a year ("year") or a unit ("unit") that is no number.
    ``record`` is the line as it stands in the file, for the last two its first two cells.
    """
    rows = _profile_rows(spark, path, checked=True)
    reason = (
        F.when(F.col("record").isNotNull(), "cells")
        .when(F.col("year").try_cast("int").isNull(), "year")
        .when(F.col("geo1").try_cast("bigint").isNull(), "unit")
    )
    judged = rows.withColumn("reason", reason)
    bad = judged.where(F.col("reason").isNotNull()).select(
        "reason", F.coalesce("record", F.concat_ws(",", "year", "geo1")).alias("record")
    )
    return _profile(judged.where(F.col("reason").isNull()), units, terms, sums), bad


def read_polygons(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Polygon layer with a ``rings`` column from Parquet or from GeoJSON lines.

    GeoJSON features of type Polygon and MultiPolygon become flat ring lists; properties stay
    as a map<string, string>.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "geojson":
        raise ValueError("fmt is 'parquet' or 'geojson'")
    schema = "properties map<string,string>, geometry struct<type:string, coordinates:string>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("f"))
    ring = "array<array<double>>"
    kind, coords = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    nested = F.when(kind == "Polygon", F.from_json(coords, f"array<{ring}>")).when(
        kind == "MultiPolygon", F.flatten(F.from_json(coords, f"array<array<{ring}>>"))
    )
    rings = F.transform(
        nested,
        lambda r: F.transform(
            r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
        ),
    ).cast(RINGS_TYPE)
    return rows.select(F.col("f.properties").alias("properties"), rings.alias("rings")).where(
        F.col("rings").isNotNull()
    )


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a table as Parquet (or CSV with a header), optionally partitioned, e.g. by yr."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt is 'parquet' or 'csv'")
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def geojson(rings: str, properties: Sequence[str] = ()) -> Column:
    """A polygon as the text of a GeoJSON feature.

    Rings inside an even number of others are outer rings, the others holes of the outer ring around
    them that lies one deeper than what is around both. Outer rings run counter-clockwise, holes
    clockwise, and all are closed. One outer ring makes a Polygon, several a MultiPolygon.
    """
    turn = sql_ring_turn("r")
    closed = "IF(element_at(r, 1) = element_at(r, -1), r, concat(r, slice(r, 1, 1)))"

    def coordinates(ring: str, counter_clockwise: bool) -> str:
        wrong = f"({turn} {'<' if counter_clockwise else '>'} 0)"
        turned = f"element_at(transform(array({ring}), r -> IF({wrong}, reverse({closed}), {closed})), 1)"
        return f"transform({turned}, p -> array(p.x, p.y))"

    held = sql_point_inside(sql_ring_edges("get(t.rings, j)"), "get(s, 0).x", "get(s, 0).y")
    nested = (
        "transform(t.rings, (s, i) -> named_struct('i', i, 'ring', s, 'in', "
        f"filter(sequence(0, size(t.rings) - 1), j -> j <> i AND {held})))"
    )
    holes = (
        "transform(filter(u.all, h -> size(h.in) = size(o.in) + 1 AND array_contains(h.in, o.i)), "
        f"h -> {coordinates('h.ring', False)})"
    )
    polygons = (
        f"transform(filter(u.all, o -> size(o.in) % 2 = 0), o -> concat(array({coordinates('o.ring', True)}), {holes}))"
    )
    # one-element arrays bind what is used more than once
    parts = (
        f"element_at(transform(transform(array(named_struct('rings', filter({rings}, r -> size(r) > 0))), "
        f"t -> named_struct('all', IF(size(t.rings) > 0, {nested}, NULL))), u -> {polygons}), 1)"
    )
    kinds = (
        f"transform(array({parts}), c -> IF(size(c) = 1, to_json(named_struct('type', 'Polygon', 'coordinates', c[0])), "
        "to_json(named_struct('type', 'MultiPolygon', 'coordinates', coalesce(c, array())))))"
    )
    own = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return F.concat(
        F.lit('{"type":"Feature","properties":'), own, F.lit(',"geometry":'), F.expr(f"element_at({kinds}, 1)"), F.lit("}")
    )


def write_geojson(df: DataFrame, path: str, rings: str = "rings", mode: str = "overwrite") -> None:
    """Write a polygon layer as GeoJSON lines, one feature a row; the other columns become properties."""
    properties = [c for c in df.columns if c != rings]
    df.select(geojson(rings, properties).alias("value")).write.mode(mode).text(path)


def write_polygons(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a polygon layer as Parquet with nested arrays."""
    df.write.mode(mode).parquet(path)
