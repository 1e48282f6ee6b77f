"""String clean-up expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import ColumnLike, col, safe_int

# Patterns that must match the source files' conventions.
ONE_CHARACTER_SUFFIX = r"\s[0-9A-Z]$"
PARENTHETICAL = r"\s\(.*\)"


def strip_suffix(c: ColumnLike) -> Column:
    """Drop a trailing one-character code: 'North Vancouver T' -> 'North Vancouver'."""
    return F.regexp_replace(col(c), ONE_CHARACTER_SUFFIX, "")


def strip_parenthetical(c: ColumnLike) -> Column:
    """Drop a bracketed number: 'Waterfront (77)' -> 'Waterfront'."""
    return F.regexp_replace(col(c), PARENTHETICAL, "")


def token(c: ColumnLike, n: int = 1) -> Column:
    """n-th token of a text split on single whitespace characters, NULL when there are fewer."""
    return F.get(F.split(col(c), r"\s"), F.lit(n - 1))


def first_tokens(c: ColumnLike, n: int = 3) -> Column:
    """The first n whitespace-separated tokens joined by one blank."""
    return F.rtrim(F.array_join(F.slice(F.split(col(c), r"\s"), 1, n), " "))


def title_token(c: ColumnLike) -> Column:
    """First token in title case: 'TORONTO CMA' -> 'Toronto'."""
    return F.initcap(token(c, 1))


def slug(c: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"\s", "_")


def plain_number(c: ColumnLike) -> Column:
    """'2,731,571[note 4]' -> 2731571; NULL when no number is left."""
    bare = F.regexp_replace(F.split_part(col(c), F.lit("["), F.lit(1)), ",", "")
    return safe_int(bare)


def recode(c: ColumnLike, mapping: Mapping[str, str], otherwise: Column | None = None) -> Column:
    """Replace category labels; labels outside the mapping keep their text."""
    c = col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, new) if out is None else out.when(c == old, new)
    rest = c if otherwise is None else otherwise
    return rest if out is None else out.otherwise(rest)


def category_position(c: ColumnLike, order: list[str]) -> Column:
    """1-based position of a label in a fixed order, NULL when it is not in the list."""
    c = col(c)
    out = F.lit(None).cast("int")
    for i, label in reversed(list(enumerate(order, start=1))):
        out = F.when(c == label, F.lit(i)).otherwise(out)
    return out
