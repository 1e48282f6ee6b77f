"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. Its integral is the source's
cumulative demand for words; inverting it gives each document, which covers a stretch of the
source's words, its position in training. Documents are range-sorted by that position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import numbered
from .common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Slope of a source's weight schedule by its place in the order of sources: weights move linearly
#: from 1 - slope at the start to 1 + slope at the end of training (mean 1, so targets hold).
SLOPES = (-0.5, 0.0, 0.5)


#: Names of a row's two 64-bit fingerprints.
TAGS = ["tag", "tag2"]


def tags(docs: DataFrame) -> list[Column]:
    """Two fingerprints of whole rows: equal rows have the same, different ones do not."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [F.xxhash64(*columns).alias(TAGS[0]), F.xxhash64(F.lit(1), *columns).alias(TAGS[1])]


def sizes(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", tagged: bool = False
) -> DataFrame:
    """doc_id, source, size: words of each text; a null or empty text has none. ``tagged`` adds the row's tags."""
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")
    named = [F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words.alias("size")]
    return docs.select(*named, *(tags(docs) if tagged else []))


def prefix_sums(df: DataFrame, by: Sequence[str], order: Column, totals: dict[str, str], rows: int) -> DataFrame:
    """Exclusive running sums {new column: summed column} by ``order`` (a hash in 0..2^60).

    Rows fall into about sqrt(rows) buckets of the order, so that neither the rows of a bucket nor
    the buckets of a group exceed what one task sorts, even if one group holds all rows. ``order``
    is spread evenly by its maker.
    """
    width = max(1, (1 << 60) // max(1, round(rows**0.5)))
    keyed = df.withColumns({"_order": order, "_bucket": F.floor(order / F.lit(width)).cast("bigint")})
    keys = [*by, "_bucket"]
    sums = keyed.groupBy(*keys).agg(*[F.sum(c).alias(f"_b_{k}") for k, c in totals.items()])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, *[F.coalesce(F.sum(f"_b_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in totals])
    inside = Window.partitionBy(*keys).orderBy("_order", *sorted(c for c in df.columns)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = keyed.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in totals.items()})
    same = [local[k].eqNullSafe(offsets[k]) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = local.join(offsets, condition)
    return joined.select(*[local[c] for c in df.columns], *[(local[k] + offsets[f"_o_{k}"]).alias(k) for k in totals])


def source_targets(
    sized: DataFrame, weights: Sequence[int], share: float, most: float
) -> DataFrame:
    """source, source_size, slope, target: words that each source gives to the mix.

    Sources in code point order, null last, get ``weights`` in turn and share ``share`` times all
    words by weight; a target stops at ``most`` times its source's words and the excess goes to the
    others by weight, until none is above.

    Raising a common level until the targets add up is the same as sharing out the excess again
    and again. Each round fixes the sources above the level and computes the level of the rest;
    a round moves two sums to the driver. It ends when no further source is above, which takes as
    many rounds as there are steps at which sources fill up.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = written(sums, "sources")
    ranked = numbered(sums, [], [F.col("source").asc_nulls_last()], "_place").withColumn("_rank", F.col("_place") - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    slope = F.element_at(F.array(*[F.lit(s) for s in SLOPES]), (F.col("_rank") % len(SLOPES) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", weight.alias("weight"), slope.alias("slope")), "weights")
    cap = F.col("source_size") * F.lit(float(most))
    total, level, full = None, 0.0, -1
    while True:
        above = cap <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, cap).otherwise(0.0)).alias("filled"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("full"),
        ).first()
        total = float(row["total"] or 0) * share
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (total - row["filled"]) / row["open"]
    target = F.least(cap, F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "slope", target.alias("target"))


def position(words: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's demand reaches ``words``.

    Demand at time t is target * ((1 - slope) * t + slope * t^2); its inverse is written so that no
    slope divides by zero.
    """
    part = F.least(F.greatest(F.try_divide(words, target), F.lit(0.0)), F.lit(1.0))
    start = 1 - slope
    return 2 * part / (start + F.sqrt(start * start + 4 * slope * part))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = 2,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    tagged: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, positions: what the mix takes of each document.

    Within a source, documents follow each other in the order of a hash of their ids, pass after
    pass. A document is taken in pass p as far as its words lie before the source's target, so the
    words taken of a source are its target rounded down, and no document gives more than ``most``
    times its size. ``positions`` are the training times of its passes, ``position`` the first
    (null if nothing is taken); the result is range-sorted by position. Row by row deterministic:
    reruns agree. Repeated rows are documents of their own; documents without words (null or empty
    text) take no words. A null source is a source of its own, the last.
    """
    # Sizes are used three times: for the sources, the bucket sums and the rows.
    sized = written(sizes(docs, text, source, doc_id, tagged), "sizes")
    targets = source_targets(sized, weights, share, most)
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    placed = prefix_sums(sized, ["source"], order, {"before": "size"}, sized.count())
    joined = placed.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    goal = F.floor("target")
    starts = [F.col("before") + p * F.col("source_size") for p in range(most)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), goal - s)) for s in starts]
    times = F.array(
        *[
            F.when(part > 0, position(start, F.col("target"), F.col("slope")))
            for part, start in zip(parts, starts, strict=True)
        ]
    )
    taken = parts[0]
    for part in parts[1:]:
        taken = taken + part
    out = joined.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        taken.cast("bigint").alias("taken"),
        F.filter(times, lambda t: t.isNotNull()).alias("positions"),
        F.array(*[p.cast("bigint") for p in parts]).alias("words"),
        *(TAGS if tagged else []),
    )
    out = out.withColumn("position", F.get("positions", 0))
    if tagged:
        return out  # to be joined, so its order would be lost
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(
        F.col("position").asc_nulls_last(), "doc_id"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in training order: whole rows, once for each pass they are taken in.

    A document that a source's target cuts appears in that pass if at least half of its words are
    taken. Documents without words appear nowhere.
    """
    doc_id = options.get("doc_id", "doc_id")
    plan = mix(docs, **options, tagged=True)
    passes = plan.select(*TAGS, "size", F.posexplode("positions").alias("pass", "position"), "words").where(
        F.col("words")[F.col("pass")] * 2 >= F.col("size")
    )
    # each row meets its own passes by its tags; of equal rows one meets the passes of all
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *tags(docs))
    twins = Window.partitionBy(*TAGS).orderBy(TAGS[0])
    once = whole.withColumn("_twin", F.row_number().over(twins)).where("_twin = 1").drop("_twin")
    rows = once.join(passes.select(*TAGS, "position"), TAGS).select("row", "position")
    rows = rows.repartitionByRange("position", F.col(f"row.`{doc_id}`")).sortWithinPartitions("position", F.col(f"row.`{doc_id}`"))
    return rows.select("row.*")
