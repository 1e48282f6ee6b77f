"""Panel files: transposed two-line CSVs (with continuation files) and two-column long CSVs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_token, token
from ..functions.values import safe_int
from ..operators.checks import assert_empty, duplicate_keys
from ..operators.scale import carry_forward, durable_table, join_on, running_totals

# File conventions of the sources.
YEAR_FOLDER = "^[0-9]"
CONTINUATION_MARK = "v2"
CELL = r',("(?:[^"]|"")*"|[^,]*)'


def year_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, file, content) of all CSV files in folders that start with a digit."""
    raw = spark.read.text(f"{root}/*/*.csv", wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("content")
    )
    return raw.select("path", *_names("path"), "content").where(F.col("folder").rlike(YEAR_FOLDER))


def _unquoted(cell: Column) -> Column:
    """A trimmed cell; a quoted one loses its quotes."""
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.trim(F.when(cell.startswith('"'), inner).otherwise(cell))


def _cells(line: Column) -> Column:
    """Cells of one CSV line; quoted cells lose their quotes."""
    # with a comma in front every cell begins with one, a blank first cell too
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(CELL), F.lit(1))
    return F.transform(raw, _unquoted)


def _names(path: str) -> list[Column]:
    """Folder and file name of a path column."""
    parts = F.split(path, "/")
    return [F.url_decode(F.element_at(parts, -k)).alias(name) for k, name in ((2, "folder"), (1, "file"))]


def file_cells(spark: SparkSession, root: str, layout: str = "folders") -> DataFrame:
    """(folder, file, line, pos, cell) of all CSV files in folders that start with a digit.

    Files are scanned by commas, not by lines, so ranges of one line are read by different tasks and
    no row holds a line, however wide. Running counts along a file put the pieces together: of quotes,
    which tell whether a comma or a line break stands inside a quoted cell, then of cells and lines.

    ``layout`` "folders" reads root/<folder>/<file>.csv; "partitions" reads what a table partitioned by
    folder and file leaves below root, one part of text for each file.
    """
    scan = spark.read.option("lineSep", ",")
    if layout == "folders":
        raw = scan.text(f"{root}/*/*.csv").select("*", *_names("_metadata.file_path"))
    elif layout == "partitions":
        raw = scan.text(root)
    else:
        raise ValueError("layout is 'folders' or 'partitions'")
    quotes = F.length("piece") - F.length(F.replace("piece", F.lit('"'), F.lit("")))
    pieces = (
        raw.where(F.col("folder").rlike(YEAR_FOLDER))
        .select(
            "folder",
            "file",
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.posexplode(F.split("value", r"\r?\n")).alias("part", "piece"),
        )
        .withColumn("own", quotes.cast("bigint"))
    )
    by, order = ["folder", "file"], ["block", "at", "part"]
    quoted = running_totals(pieces, by, [F.col(c).asc() for c in order], {"quotes": F.col("own")})
    begins = ((F.col("quotes") - F.col("own")) % 2 == 0).cast("bigint")
    breaks = begins * (F.col("part") > 0).cast("bigint")
    placed = running_totals(
        quoted.withColumns({"begins": begins, "breaks": breaks}),
        by,
        [F.col(c).asc() for c in order],
        {"number": F.col("begins"), "line": F.col("breaks")},
    )
    between = F.when(F.col("begins") == 1, "").when(F.col("part") > 0, "\n").otherwise(",")
    piece = F.struct(*order, F.concat(between, "piece").alias("text"))
    cells = placed.groupBy(*by, "number").agg(
        F.min("line").alias("line"), F.sort_array(F.collect_list(piece)).alias("pieces")
    )
    cell = F.array_join(F.transform("pieces", lambda x: x["text"]), "")
    firsts = cells.groupBy(*by, "line").agg(F.min("number").alias("first"))
    return join_on(cells.select(*by, "line", "number", _unquoted(cell).alias("cell")), firsts, [*by, "line"]).select(
        *by, "line", (F.col("number") - F.col("first")).cast("int").alias("pos"), "cell"
    )


def parse_cells(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Panel and aggregate rows of transposed files from ``file_cells``, as ``parse_transposed`` gives
    them: unit ids meet their values by place in the file."""
    cells = durable_table(cells)
    by = ["folder", "file"]

    def at(line: int, pos: int) -> Column:
        return F.max(F.when((F.col("line") == line) & (F.col("pos") == pos), F.col("cell")))

    heads = (
        cells.where("line <= 1 AND pos <= 1")
        .groupBy(*by)
        .agg(at(0, 0).alias("title"), at(0, 1).alias("city"), at(1, 1).alias("total"))
    )
    return _joined(
        _head(heads, F.col("title"), F.col("city"), F.col("total")),
        join_on(
            cells.where("line = 0").select(*by, "pos", F.col("cell").alias("unit")),
            cells.where("line = 1").select(*by, "pos", F.col("cell").alias("value")),
            [*by, "pos"],
            "left",
        ).where(F.col("pos") >= F.when(_continues(), 1).otherwise(2)),
    )


def _continues() -> Column:
    return F.col("file").contains(CONTINUATION_MARK)


def _head(files: DataFrame, title: Column, city: Column, total: Column) -> DataFrame:
    """One slim row per file: year, city and total, the last two only where the file has them."""
    return files.select(
        "folder",
        "file",
        _continues().alias("is_v2"),
        safe_int(token(title, 1)).cast("int").alias("yr"),
        F.when(~_continues(), title_token(city)).alias("group"),
        F.when(~_continues(), safe_int(total)).alias("pop"),
    )


def _joined(head: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Panel and aggregate from the files' heads and their cells (folder, file, unit, value)."""
    # one slim row per file carries the city forward; the cells are joined back by file
    order = [F.col("folder").asc(), F.col("file").asc()]
    cities = carry_forward(head.select("folder", "file", "group", "yr"), "group", order)
    units = cells.select("folder", "file", safe_int("unit").alias("unit"), safe_int("value").alias("value"))
    panel = join_on(units, cities, ["folder", "file"], null_safe=False).select("group", "unit", "yr", "value")
    return panel, head.where(~F.col("is_v2")).select("group", "yr", "pop")


def parse_transposed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Panel and aggregate rows of transposed files (folder, file, content).

    Line 1 holds '<year> ...', '<CITY> ...' and unit ids, line 2 a label, the city total and
    the units' values. Continuation files have no city cell and belong to the city of the
    last file before them in (folder, file) order. Returns panel (group, unit, yr, value) and
    aggregate (group, yr, pop).
    """
    lines = F.split("content", r"\r?\n")
    heads = _cells(F.get(lines, F.lit(0)))
    values = _cells(F.get(lines, F.lit(1)))
    cut = files.select("folder", "file", heads.alias("h"), values.alias("v"))
    first_unit = F.when(_continues(), 2).otherwise(3)
    cells = cut.select(
        "folder",
        "file",
        F.posexplode(
            F.arrays_zip(
                F.slice("h", first_unit, F.size("h")).alias("unit"),
                F.slice("v", first_unit, F.size("v")).alias("value"),
            )
        ).alias("pos", "cell"),
    ).where(F.col("cell.unit").isNotNull())
    head = _head(cut, F.get("h", F.lit(0)), F.get("h", F.lit(1)), F.get("v", F.lit(1)))
    return _joined(head, cells.select("folder", "file", "cell.unit", "cell.value"))


def parse_long(
    rows: DataFrame, year: int | Column, prefix_groups: Mapping[str, str], other_group: str
) -> tuple[DataFrame, DataFrame]:
    """Panel and aggregate rows of two-column files (geo, pop).

    The first token of geo is a unit id when it starts with a digit and a city name when it
    has an upper-case letter; the id's prefix gives the group.
    """
    yr = F.lit(year) if isinstance(year, int) else year
    parsed = rows.select(
        token("geo", 1).alias("geo"), safe_int("pop").alias("pop"), yr.cast("int").alias("yr")
    )
    group = F.lit(other_group)
    for prefix, name in prefix_groups.items():
        group = F.when(F.col("geo").startswith(prefix), name).otherwise(group)
    panel = parsed.where(F.col("geo").rlike("^[0-9]")).select(
        group.alias("group"),
        safe_int("geo").alias("unit"),
        "yr",
        F.col("pop").alias("value"),
    )
    aggregate = parsed.where(F.col("geo").rlike("[A-Z]")).select(
        title_token("geo").alias("group"), "yr", "pop"
    )
    return panel, aggregate


def read_transposed_panel(
    spark: SparkSession, root: str, layout: str = "folders"
) -> tuple[DataFrame, DataFrame]:
    """Panel and aggregate rows of all transposed files under ``root``/<year...>/."""
    return parse_cells(file_cells(spark, root, layout))


def read_long_panel(
    spark: SparkSession,
    path: str,
    year: int,
    prefix_groups: Mapping[str, str],
    other_group: str,
) -> tuple[DataFrame, DataFrame]:
    """Panel and aggregate rows of a two-column CSV; further columns are not read."""
    rows = spark.read.schema("geo string, pop string").csv(
        path, header=True, enforceSchema=True, mode="PERMISSIVE", escape='"'
    )
    return parse_long(rows, year, prefix_groups, other_group)


def checked_panel(panel: DataFrame) -> DataFrame:
    """The panel, after checking that (group, yr, unit) is unique."""
    assert_empty(duplicate_keys(panel, ["group", "yr", "unit"]), "duplicate panel keys")
    return panel
