"""Building blocks that keep hot keys and large groups spread over the cluster.

* ``skew_join``      equi-join that spreads keys with more rows than a task should read
* ``running_totals`` exact prefix sums over groups of any size (no one-task window)
* ``durable_table``  cut a plan by writing it to the shared checkpoint folder

Small lookups are joined plainly: written tables and run-time statistics carry real sizes, from
which Spark picks a broadcast or a shuffle.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one key that a task may read; ``skew_join`` splits keys with more.
ROWS_PER_TASK = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's checkpoint folder, which all executors reach.

    Only a session that runs in one process may leave it unset and gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paneldrift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The sub-folder that holds all intermediate tables of this application."""
    return f"{shared_folder(spark)}/paneldrift-{spark.sparkContext.applicationId}"


#: Spark's setting that deletes an execution's shuffle files when it ends.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once and read it back: later steps see fixed rows and survive lost executors.

    The shuffle files of the write are deleted when it ends, as nothing can read them again, so a chain
    of tables takes the disk of one step and not of all."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    try:
        if before is not None:
            spark.conf.set(CLEAN_SHUFFLES, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEAN_SHUFFLES, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._durable_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``durable_table`` made; all frames that read them must have been computed."""
    for table in tables:
        _delete(table.sparkSession, table._durable_path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; frames that read them are void then."""
    _delete(spark, run_folder(spark))


def join_on(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join that keeps one copy of the keys.

    Plain equality lets a side that is already partitioned by the keys stay where it is. With
    ``null_safe`` NULL keys match each other, for keys that can be NULL."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}")) if null_safe else F.col(k) == F.col(f"_r_{k}")
        condition = eq if condition is None else condition & eq
    joined = left.join(renamed, condition, how)
    if how in ("right", "full", "outer", "full_outer"):
        joined = joined.withColumns(
            {k: (F.col(f"_r_{k}") if how == "right" else F.coalesce(k, f"_r_{k}")) for k in keys}
        )
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_r_{k}" for k in keys])


def heavy_keys(counts: DataFrame, n: str, rows_per_task: int) -> DataFrame:
    """Keys with more rows than a task should read: at most 1/rows_per_task of all rows."""
    return counts.where(F.col(n) > rows_per_task)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    counts: DataFrame,
    right_counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner equi-join whose hot keys are spread over a grid of tasks.

    ``counts`` (keys, n) are the rows per key of the left side, ``right_counts`` of the right. A
    key with more than ``rows_per_task`` rows on a side is cut into as many parts of that side as
    keep each below it; the other side's rows of the key go to every part. Without such a key
    this is a plain join. NULL keys match nothing.
    """
    hot = heavy_keys(counts, "n", rows_per_task).select(*keys, F.col("n").alias("_nl"))
    if right_counts is not None:
        other = heavy_keys(right_counts, "n", rows_per_task).select(*keys, F.col("n").alias("_nr"))
        hot = hot.join(other, list(keys), "full")
    else:
        hot = hot.withColumn("_nr", F.lit(None).cast("bigint"))
    parts = {
        side: F.greatest(F.ceil(F.coalesce(n, F.lit(0)) / rows_per_task), F.lit(1)).cast("int")
        for side, n in (("_pl", F.col("_nl")), ("_pr", F.col("_nr")))
    }
    hot = durable_table(hot.select(*keys, *[c.alias(k) for k, c in parts.items()]))
    if hot.isEmpty():
        return join_on(left, right, keys)

    def spread(df: DataFrame, own: str, others: str, mine: str, theirs: str) -> DataFrame:
        one = join_on(df, hot, keys, "left")
        # by the row's values alone: a recomputed task deals its rows to the same slots
        slot = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1)))
        copies = F.sequence(F.lit(0), F.coalesce(others, F.lit(1)) - 1)
        return one.withColumn(mine, slot.cast("int")).withColumn(theirs, F.explode(copies)).drop("_pl", "_pr")

    return join_on(
        spread(left, "_pl", "_pr", "_sl", "_sr"), spread(right, "_pr", "_pl", "_sr", "_sl"), [*keys, "_sl", "_sr"]
    ).drop("_sl", "_sr")


def left_join_many(dim: DataFrame, many: DataFrame, keys: Sequence[str]) -> DataFrame:
    """dim left join many, for a ``many`` side that may hold a hot key.

    Matches are found from the many side, whose hot keys an inner join can split at run time;
    dim rows without a match are added with NULLs.
    """
    matched = join_on(many, dim, keys, "inner")
    unmatched = join_on(dim, many.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def with_totals(
    df: DataFrame, by: Sequence[str], totals: Mapping[str, Column], pre: DataFrame | None = None
) -> DataFrame:
    """Attach per-group aggregates to every row of an aggregated table: aggregate with map-side
    combine, then join back.

    Unlike a window over the group this never gathers a whole group in one task. Rows with a
    NULL key have no group and drop out.
    """
    agg = (df if pre is None else pre).groupBy(*by).agg(*[c.alias(k) for k, c in totals.items()])
    return join_on(df, agg, by, "inner")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    whole: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exact inclusive running totals of each group in a total order, however large the group.

    Rows are range-partitioned by (group, order) and written once, so partition numbers are
    fixed. Each slice is summed locally. Only the group a slice begins with can have rows in
    earlier slices, so the offsets to add are at most one row per slice, which bounds what is
    broadcast. ``whole`` names columns for the group's final totals, {total: column}, which come
    from the slice sums too.
    """
    weights = {f"_w_{k}": c for k, c in totals.items()}
    ranged = durable_table(
        df.withColumns(weights)
        .repartitionByRange(*[F.col(b).asc_nulls_first() for b in by], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    slice_keys = [*by, "_slice"]
    sums = ranged.groupBy(*slice_keys).agg(*[F.sum(w).alias(w) for w in weights])
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        sums.select(
            *slice_keys,
            F.count(F.lit(1)).over(earlier).alias("_before"),
            *[F.sum(f"_w_{k}").over(earlier).alias(f"_o_{k}") for k in totals],
        )
        .where(F.col("_before") > 0)
        .drop("_before")
    )
    within = (
        Window.partitionBy(*slice_keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumns({k: F.sum(f"_w_{k}").over(within) for k in totals})
    running = (
        join_on(local, F.broadcast(offsets), slice_keys, "left", null_safe=True)
        .withColumns({k: F.col(k) + F.coalesce(f"_o_{k}", F.lit(0)) for k in totals})
        .drop("_slice", *weights, *[f"_o_{k}" for k in totals])
    )
    if not whole:
        return running
    final = sums.groupBy(*by).agg(*[F.sum(f"_w_{k}").alias(c) for k, c in whole.items()])
    return join_on(running, final, by, "left", null_safe=True)


def numbered(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """row_number for groups of any size; ``order`` must be a total order within the group."""
    return running_totals(df, by, order, {name: F.lit(1).cast("bigint")})


def carry_forward(df: DataFrame, column: str, order: Sequence[Column]) -> DataFrame:
    """Fill NULLs of ``column`` with the last value before them in a global total order."""
    segmented = running_totals(
        df, [], order, {"_segment": F.col(column).isNotNull().cast("bigint")}
    )
    heads = segmented.where(F.col(column).isNotNull()).select(
        "_segment", F.col(column).alias("_head")
    )
    return (
        join_on(segmented, heads, ["_segment"], "left")
        .withColumn(column, F.coalesce(column, "_head"))
        .drop("_segment", "_head")
    )


def ordered_gaps(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], column: str, name: str = "gap"
) -> DataFrame:
    """Row number in the group and the difference to the row before it, for groups of any size.

    The row before lies in the same slice of the ordered rows, but for the first row of a slice;
    for that, the last value of each (group, slice) is carried over, one row per slice.
    """
    ranged = durable_table(
        df.repartitionByRange(*[F.col(b).asc_nulls_first() for b in by], *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    keys = [*by, "_slice"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = ranged.withColumns(
        {"_rn": F.row_number().over(inside), "_lag": F.lag(column).over(inside), "_last": F.lead(F.lit(1)).over(inside)}
    )
    ends = local.where(F.col("_last").isNull()).select(*keys, F.col("_rn").alias("_n"), F.col(column).alias("_end"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_slice")
    offsets = ends.select(
        *keys,
        F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_end").over(earlier).alias("_carried"),
    ).where(F.col("_before").isNotNull())
    return (
        join_on(local, F.broadcast(offsets), keys, "left", null_safe=True)
        .withColumn(name, F.col(column) - F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_lag")))
        .withColumn("rn", (F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_slice", "_rn", "_lag", "_last", "_before", "_carried")
    )
