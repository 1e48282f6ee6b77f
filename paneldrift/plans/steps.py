"""The four steps of a panel study as functions from files to tables.

Each step reads the raw files or the tables of the step before, writes its tables as Parquet
below ``out`` and returns them. Checks run before anything is written.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import polygon_area
from ..functions.text import strip_parenthetical
from ..operators import areas as A
from ..operators import checks as K
from ..operators import classes as C
from ..operators import dictionary as D
from ..operators import growth as G
from ..operators import spatial as X
from ..operators import stats as M
from ..operators.pairs import churn, jaccard, pair_values, presence
from ..operators.scale import join_on
from ..sources import panels as SP
from ..sources.tables import read_dictionary, read_profile, rename_columns, write_table

PROFILE_MEANS = ["singd", "semd", "row", "income", "apt"]


def _written(spark: SparkSession, out: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    for name, df in tables.items():
        write_table(df, f"{out}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{out}/{name}") for name, df in tables.items()}


def ingest(
    spark: SparkSession,
    root: str,
    out: str,
    long_files: Mapping[int, str] | None = None,
    prefix_groups: Mapping[str, str] | None = None,
    other_group: str = "other",
) -> dict[str, DataFrame]:
    """Transposed year folders and long files to ``panel`` and ``aggregate``."""
    panel, totals = SP.read_transposed_panel(spark, root)
    for year, path in (long_files or {}).items():
        more, more_totals = SP.read_long_panel(spark, path, year, prefix_groups or {}, other_group)
        panel, totals = panel.unionByName(more), totals.unionByName(more_totals)
    return _written(spark, out, {"panel": SP.checked_panel(panel), "aggregate": totals})


def describe_units(
    spark: SparkSession,
    out: str,
    panel: DataFrame,
    dictionary_path: str,
    bridge: DataFrame,
    cities: DataFrame,
    core: str,
    profile_paths: Mapping[str, str],
    min_count: int = 10,
    terms: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Unit dictionary, bridge with alternative area names and one profile row per unit.

    ``profile_paths`` maps a province tag to its long profile file.
    """
    dictionary = read_dictionary(spark, dictionary_path)
    K.assert_empty(K.unknown_keys(panel, dictionary, ["unit"]), "units without dictionary row")
    known = join_on(
        dictionary, panel.select("unit").distinct(), ["unit"], "left_semi", null_safe=False
    )
    named = D.clean_bridge(bridge).select("unit", F.col("csd").alias("csd_bridge"))
    K.assert_empty(
        K.disagreements(known, named, ["unit"], "csd", "csd_bridge"), "dictionary and bridge name different areas"
    )
    linked = D.build_dictionary(known, bridge, cities, panel, core, min_count)
    profile = None
    for tag, path in profile_paths.items():
        one = read_profile(spark, path, panel, terms).withColumn("prov", F.lit(tag))
        profile = one if profile is None else profile.unionByName(one)
    if profile is not None:
        K.assert_empty(K.duplicate_keys(profile, ["unit"]), "units with several profile rows")
    return _written(spark, out, {"dictionary": known, "bridge": linked, "profile": profile})


def analyse(
    spark: SparkSession,
    out: str,
    panel: DataFrame,
    aggregate: DataFrame,
    bridge: DataFrame,
    lump_min: int = 80,
) -> dict[str, DataFrame]:
    """Presence, growth, decomposition and area tables of a panel."""
    columns = ["cma", "csd", "ccsd", "cd", "csd_alt"]
    modes = D.most_common(bridge, "unit", columns).drop("n")
    pairs = _written(
        spark, out, {"pairs": pair_values(panel, by_unit_only=True), "modes": modes}
    )
    pv, modes = pairs["pairs"], pairs["modes"]
    totals = G.period_totals(panel)
    parts = G.decompose(pv)
    classified = _written(
        spark, out, {"change_class": C.change_class_area(pv, modes, "csd", lump_min)}
    )["change_class"]
    cells = presence(panel)
    net = C.net_by(classified, ["group", "csd"], with_total=True)
    return {**pairs, "change_class": classified} | _written(
        spark,
        out,
        {
            "presence": cells,
            "jaccard": jaccard(cells),
            "churn": churn(presence(panel, "consecutive")),
            "index": G.stacked_index({"agg": aggregate, "DA": totals}),
            "reconciliation": G.reconcile(aggregate, totals),
            "growth_units": G.growth_like_for_like(pv),
            "growth_actual": G.growth_aggregate(aggregate),
            "cohorts": G.cohort_index(panel),
            "decomposition": parts,
            "counterfactual": G.counterfactual(parts, totals),
            "gain_loss": C.gain_loss(pv),
            "sign_counts": C.sign_counts(pv),
            "sign_share": C.sign_share(pv, D.mean_coordinates(bridge, "unit", ["lat", "lon"])),
            "area_periods": C.net_by(classified, ["group", "y1", "y2", "csd_lump"]),
            "area_totals": C.share_of_total(net, "d_m", ["tt", "group"]),
        },
    )


def map_areas(
    spark: SparkSession,
    out: str,
    tables: Mapping[str, DataFrame],
    units: DataFrame,
    areas: DataFrame,
    inside: str,
    last_year: int,
    rename: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Unit-to-area assignment, area roll-ups and the modelling table.

    ``tables`` holds pairs, change_class, modes and profile; ``units`` and ``areas`` are polygon
    layers (id, name, ord, rings), and units of the area ``inside`` must all get an area.
    """
    named = areas.withColumn("name", strip_parenthetical("name"))
    assigned = X.assign_area(units, named).withColumnRenamed("id", "unit")
    modes = tables["modes"].select("unit", "csd", F.col("csd_alt").alias("parent"))
    labelled = join_on(assigned, modes, ["unit"], "left", null_safe=False).where(F.col("csd") == inside)
    di = _written(spark, out, {"unit_area": labelled.select("unit", "parent", "area")})["unit_area"]
    K.assert_empty(K.unassigned(di, "area"), "units without area")
    changes = A.area_changes(tables["change_class"], di)
    levels = A.area_levels(tables["pairs"], di)
    first = _written(
        spark, out, {"area_changes": changes, "area_levels": levels}
    )
    rolled = A.rollup_area(first["area_changes"], di, rename=rename)
    inside_profile = join_on(tables["profile"], di, ["unit"], null_safe=False)
    means = M.weighted_means(inside_profile, ["area"], PROFILE_MEANS, "pop")
    sizes = named.select(F.col("name").alias("area"), polygon_area("rings", "spherical").alias("size"))
    last = first["area_levels"].where(F.col("y2") == last_year)
    model = M.model_table(
        rolled, sizes, means, last.select("area", F.col("m2").alias("level")), "area"
    )
    dense = A.density(
        join_on(first["area_levels"], sizes, ["area"], null_safe=False), "m2", "size"
    )
    return {**first, "unit_area": di} | _written(
        spark,
        out,
        {
            "area_rollup": rolled,
            "enrichment": A.enrichment(rolled, "parent"),
            "area_density": dense,
            "model": model,
            "area_edges": X.dissolve(
                join_on(units.withColumnRenamed("id", "unit").select("unit", "rings"), di, ["unit"], null_safe=False),
                ["area"],
            ),
        },
    )


def fit_model(model: DataFrame) -> DataFrame:
    """Coefficient table of the area model: change in thousands on size, income and shares."""
    table = model.select(
        (F.col("d_m") / 1000).alias("y"),
        F.col("size").alias("area"),
        "income", "singd", "semd", "row", "apt",
    )
    return M.ols_table(M.growth_regression(table, "y"), M.MODEL_TERMS, table)


def read_bridge(df: DataFrame) -> DataFrame:
    """Bridge file columns to the library's names."""
    # Column names of the bridge file.
    names = {
        "DA_dauid": "unit",
        "DA_csdname": "csd",
        "PostCode": "postcode",
        "Latitude": "lat",
        "Longitude": "lon",
    }
    return rename_columns(df, names).select(*names.values())
