"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on the statistics of labelled documents; every path from a root becomes a rule, a
conjunction of comparisons; a lasso logistic regression weighs the rules and drops most; the rest
is compiled into one Spark column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES = 16
DEPTH = 3
LASSO = 0.001


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text (null: empty), all counted over the whole text."""
    t = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("double")

    return {
        "chars": F.length(t).cast("double"),
        "words": count(r"\S+"),
        "upper": count(r"\p{Lu}"),
        "marks": count(r"[^\p{L}\p{N}\s.,;:'\"()-]"),
        "digits": count(r"[0-9]"),
        "stops": count(r"[.,;:]"),
        "lines": count(r"\n"),
        "twice": count(r"(?<!\S)(\S+)(?: \1(?!\S))+"),
        "distinct": F.size(F.array_distinct(F.split(t, r"\s+"))).cast("double"),
    }


def features() -> dict[str, Column]:
    """Ratios of the statistics: what the rules compare."""
    chars, words = F.greatest("chars", F.lit(1.0)), F.greatest("words", F.lit(1.0))
    return {
        "log_words": F.log1p("words"),
        "word_length": F.col("chars") / words,
        "upper_share": F.col("upper") / chars,
        "mark_share": F.col("marks") / words,
        "digit_share": F.col("digits") / chars,
        "stop_share": F.col("stops") / words,
        "line_length": words / (F.col("lines") + 1),
        "twice_share": F.col("twice") / words,
        "distinct_share": F.col("distinct") / words,
    }


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the features of each row's text."""
    plain = docs.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(k) for k, c in statistics(F.col(f"`{text}`")).items()])
    return plain.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(k) for k, c in features().items()])


Condition = tuple[str, str, float]


@dataclass
class Rules:
    """Rules with weights: ((feature, "<=" or ">", threshold), ...) and the intercept."""

    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column over the features."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(conditions: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, sign, value in conditions:
        out = out & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
    return out


def paths(node, names: list[str], before: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Rules of a tree: the conditions on the way to each node below its root."""
    found = [before] if before else []
    if node.getClass().getSimpleName() != "InternalNode":
        return found
    name, value = names[node.split().featureIndex()], float(node.split().threshold())
    return (
        found
        + paths(node.leftChild(), names, (*before, (name, "<=", value)))
        + paths(node.rightChild(), names, (*before, (name, ">", value)))
    )


def fit(
    rows: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO
) -> Rules:
    """Fit on rows of features with a 0/1 label; other labels are left out.

    Trees and regression are fitted by Spark over all labelled rows. The number of rules is bounded by
    trees x 2^(depth + 1). With one label only, the score is that label's smoothed share; without any
    labelled row it is 0.5.
    """
    names = list(features())
    labelled = rows.where(F.col(label).isin(0, 1)).select(*names, F.col(label).cast("double").alias("label"))
    n, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return Rules([], math.log(share / (1 - share)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt", minInstancesPerNode=5)
    grown = forest.fit(VectorAssembler(inputCols=names, outputCol="features").transform(labelled))
    rules = sorted({rule for tree in grown.trees for rule in paths(tree._call_java("rootNode"), names)})
    if not rules:
        share = (ones + 1) / (n + 2)
        return Rules([], math.log(share / (1 - share)))
    fires = F.array(*[holds(rule).cast("double") for rule in rules])
    matrix = labelled.select("label", array_to_vector(fires).alias("features"))
    lines = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(matrix)
    weights = lines.coefficients.toArray()
    return Rules([(r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0.0], float(lines.intercept))


def score(rows: DataFrame, rules: Rules, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and score for rows of features. A null or empty text is scored like any
    other, by statistics of zero; repeated rows stay."""
    return rows.select(*[F.col(f"`{c}`") for c in keep], rules.score().alias("score"))
