"""Secret scans: fixed patterns, and a pair of character Markov models for other random strings.

Everything is a DataFrame expression: no row leaves the JVM.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

# The base patterns, the kinds in order, and the shortest match that counts.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the Markov models judge, and the characters they know.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: For each pair of neighbouring characters, see the README.
MIN_RATIO = 0.1
#: Weight of a model's own character frequencies in its transitions, in pairs.
PRIOR = 5.0
#: Texts with more spans are redacted through an array of their characters.
MANY_SPANS = 64


def _running(values: Column, op, start: int) -> Column:
    """Inclusive running totals of an array of ints under ``op``.

    Chunks of about the square root of the array are totalled on their own and then shifted, so no
    long array is copied for each of its elements.
    """

    def totals(chunk: Column) -> Column:
        zero = F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = op(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(chunk, zero, step, lambda acc: acc["out"])

    def shifted(chunks: Column) -> Column:
        ends = totals(F.transform(chunks, lambda c: F.get(c, F.size(c) - 1)))
        before = F.concat(F.array(F.lit(start)), ends)
        moved = F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, o: F.transform(c, lambda x: op(o, x)))
        return F.flatten(moved)

    def chunked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"), F.lit(1))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), width)
        return F.transform(firsts, lambda i: totals(F.slice(v, i, width)))

    none = F.array().cast("array<int>")
    return F.when(F.size(values) > 0, bound(bound(values, chunked), shifted)).otherwise(none)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, pattern: str, ok) -> Column:
    """Matches of a pattern as array of (start, end, text): code points, end exclusive.

    The pieces between matches come from ``split``, the matches from ``regexp_extract_all``;
    their lengths add up to positions. ``ok`` gets all matches and gives an array of booleans.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.struct(found.alias("hits"), F.split(text, pattern, -1).alias("gaps"), ok.alias("ok"))

    def placed(m: Column) -> Column:
        sizes = F.zip_with(
            F.slice(m["gaps"], F.lit(1), F.size(m["hits"])), m["hits"], lambda g, h: F.length(g) + F.length(h)
        )
        rows = F.arrays_zip(_running(sizes, _sum, 0).alias("end"), m["hits"].alias("hit"), m["ok"].alias("ok"))
        return F.transform(
            F.filter(rows, lambda r: r["ok"]),
            lambda r: F.struct((r["end"] - F.length(r["hit"])).alias("start"), r["end"].alias("end"), r["hit"].alias("hit")),
        )

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(text.rlike(pattern), bound(pieces, placed)).otherwise(none)


def _free(spans: Column, base: Column) -> Column:
    """The spans that overlap no base span: both are walked once in order of their starts.

    A span is free if no base span that begins before it reaches into it, and the next one begins
    behind it.
    """
    none = F.lit(None).cast("string")
    both = F.array_sort(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), none.alias("hit"))),
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), s["hit"].alias("hit"))),
        )
    )
    far = (1 << 31) - 1

    def walked(rows: Column) -> Column:
        reach = _running(F.transform(rows, lambda r: F.when(r["own"] == 0, r["end"]).otherwise(0)), F.greatest, 0)
        starts = F.transform(F.reverse(rows), lambda r: F.when(r["own"] == 0, r["start"]).otherwise(F.lit(far)))
        following = F.reverse(_running(starts, F.least, far))
        kept = F.filter(
            F.arrays_zip(rows.alias("r"), reach.alias("reach"), following.alias("next")),
            lambda x: (x["r"]["own"] == 1) & (x["reach"] <= x["r"]["start"]) & (x["next"] >= x["r"]["end"]),
        )
        return F.transform(
            kept, lambda x: F.struct(x["r"]["start"].alias("start"), x["r"]["end"].alias("end"), x["r"]["hit"].alias("hit"))
        )

    return F.when((F.size(spans) > 0) & (F.size(base) > 0), bound(both, walked)).otherwise(spans)


def _assign(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    return _spans(text, ASSIGN, F.transform(values, lambda v: F.length(v) >= ASSIGN_VALUE))


def _always(text: Column, pattern: str) -> Column:
    return _spans(
        text, pattern, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda _: F.lit(True))
    )


def base_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus _text (null: empty), _assign, _access, _hex: spans of the base kinds."""
    full = docs.withColumn("_text", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return full.withColumns(
        {"_assign": _assign(F.col("_text")), "_access": _always(F.col("_text"), ACCESS), "_hex": _always(F.col("_text"), HEX)}
    )


# ---------------------------------------------------------------- Markov models


@dataclass
class Markov:
    """Log ratio of both models' probabilities for each pair of neighbouring characters."""

    ratios: list[float]

    def score(self, token: Column) -> Column:
        """Log-likelihood ratio of a string: positive if it looks random."""
        # one folded literal: the table has the alphabet's size squared, whatever the data
        table = F.from_json(F.lit(json.dumps(self.ratios)), "array<double>")
        # no split at the end: it would leave an empty character, which is found at the alphabet's beginning
        codes = F.transform(F.split(token, r"(?!^)(?!\z)"), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        pairs = F.zip_with(
            codes, F.slice(codes, F.lit(2), F.size(codes)), lambda a, b: F.get(table, a * len(ALPHABET) + b)
        )
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """token, label: what the base patterns find is random (1), words of six or more characters elsewhere are not (0)."""
    scanned = base_scan(docs.select(F.col(f"`{text}`").alias("text")))
    hits = F.concat("_assign", "_access", "_hex")
    value = F.regexp_extract(F.col("s.hit"), r"([A-Za-z0-9+/_=-]+)[.]*$", 1)
    random = scanned.select(F.explode(hits).alias("s")).select(value.alias("token"), F.lit(1).alias("label"))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = scanned.select(F.explode(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))).alias("token"))
    return random.union(words.select("token", F.lit(0).alias("label"))).where(F.length("token") > 1)


def train(docs: DataFrame, text: str = "text") -> Markov:
    """Fit both models on the labelled strings of all documents.

    Pair counts are aggregated by Spark; the driver receives one count for each pair of characters and label.
    """
    tokens = labelled(docs, text)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, 2)))
    counts = tokens.select("label", pair.alias("pair")).groupBy("label", "pair").count().collect()
    seen: list[dict[tuple[int, int], int]] = [{}, {}]
    for row in counts:
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b >= 0:
            seen[row["label"]][a, b] = row["count"]
    ordinary, random = (_transitions(pairs) for pairs in seen)
    ratios = [round(r - o, 4) for o, r in zip(ordinary, random, strict=True)]
    # a repeated character is no sign of randomness: rulers hold nothing else
    repeated = {a * len(ALPHABET) + a for a in range(len(ALPHABET))}
    return Markov([min(x, 0.0) if k in repeated else x for k, x in enumerate(ratios)])


def _transitions(pairs: dict[tuple[int, int], int]) -> list[float]:
    """Log probabilities of a character after another: counts, backed off to the frequencies of characters.

    A character that the labelled strings never hold before another is followed by what is frequent
    in them, so a model's rare rows are not flat.
    """
    n = range(len(ALPHABET))
    before, after = [0] * len(n), [1] * len(n)
    for (a, b), count in pairs.items():
        before[a] += count
        after[b] += count
    total = sum(after)
    return [
        math.log((pairs.get((a, b), 0) + PRIOR * after[b] / total) / (before[a] + PRIOR)) for a in n for b in n
    ]


# ---------------------------------------------------------------- the scan


def scan(docs: DataFrame, model: Markov, text: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """docs plus secrets: array of (start, order, end) sorted, order = place of the kind in KINDS.

    Base kinds hold the patterns' matches. "markov" adds strings of 16 or more letters, digits and
    +/_=- that overlap no base span and whose log-likelihood ratio, for each pair of neighbouring
    characters, is at least ``min_ratio``.
    A null or empty text has no spans. Rows stay as they are, repeated ones too; work is per row. In a
    text of n matches positions cost about n^1.5 small steps, so tens of thousands of secrets in one
    text are no problem.
    """
    found = base_scan(docs, text)
    base = [_kind(F.col(c), k) for k, c in enumerate(("_assign", "_access", "_hex"))]
    found = found.withColumns({"_base": F.concat(*base), "_long": _always(F.col("_text"), CANDIDATE)})
    free = _free(F.col("_long"), F.col("_base"))
    more = _kind(F.filter(free, lambda s: model.score(s["hit"]) >= min_ratio * (F.length(s["hit"]) - 1)), len(base))
    found = found.withColumn("secrets", F.array_sort(F.concat("_base", more)))
    return found.drop("_text", "_assign", "_access", "_hex", "_base", "_long")


def _kind(spans: Column, order: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"))
    )


def spelled(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"]))
    )


def redact(docs: DataFrame, model: Markov, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the scan replaced by ``mark``; overlapping spans become one mark."""
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = scan(rows, model, "text")
    many = F.size("secrets") > MANY_SPANS
    # substring walks the text from its beginning, so texts with many spans are taken as arrays
    characters = F.when(many, F.split("text", "(?!^)")).otherwise(F.array().cast("array<string>"))
    row = F.struct(F.col("text"), F.col("secrets"), characters.alias("characters"))

    def marked(r: Column) -> Column:
        def cut(first: Column, last: Column) -> Column:
            some = F.array_join(F.slice(r["characters"], first + 1, last - first), "")
            return F.when(F.size(r["characters"]) > 0, some).otherwise(F.substring(r["text"], first + 1, last - first))

        def joined(reach: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1))
            fresh = F.filter(
                F.arrays_zip(r["secrets"].alias("s"), before.alias("before")), lambda x: x["s"]["start"] >= x["before"]
            )
            parts = F.transform(fresh, lambda x: F.concat(cut(x["before"], x["s"]["start"]), F.lit(mark)))
            tail = cut(F.get(reach, F.size(reach) - 1), F.length(r["text"]))
            return F.concat(F.array_join(parts, ""), tail)

        return bound(_running(F.transform(r["secrets"], lambda s: s["end"]), F.greatest, 0), joined)

    clean = bound(row, marked)
    clean = F.when(F.size("secrets") > 0, clean).otherwise(F.col("text"))
    return found.select(
        *[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns]
    )
