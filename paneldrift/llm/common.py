"""Shared helpers: written tables, text bytes of Arrow batches, fingerprints, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import discard, durable_table, release_tables

CHUNK_BYTES = 1 << 20


#: Tables between steps: written into the shared folder and read back, see operators/scale.py.
written = durable_table
release = release_tables


# ---------------------------------------------------------------- bytes of Arrow batches


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``limit`` bytes of text, with their UTF-8 bytes and offsets.

    A null text counts as empty. A text longer than ``limit`` makes a slice of its own.
    """
    for batch in batches:
        texts = batch.column(column).cast(pa.large_string()).fill_null("")
        if len(texts) == 0:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), len(texts))
            part = offsets[first : last + 1]
            yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            first = last


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that what is made of a part stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """BASE to the powers 0..n-1 modulo 2^64 ("down": of its inverse)."""
    if len(_powers[kind]) < n:
        size = max(n, 2 * len(_powers[kind]))
        base = np.full(size, BASE if kind == "up" else _BASE_INVERSE)
        base[0] = 1
        _powers[kind] = np.multiply.accumulate(base)
    return _powers[kind][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, from which ``range_hashes`` takes any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the substrings [start, end): equal bytes give equal values anywhere."""
    down = powers(len(prefix), "down")
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (id, component), component = smallest id reachable.

    Alternates two steps until only stars are left: every node points its larger neighbours to the
    smallest node it sees, then its smaller ones. Minima are aggregated with map-side combine and
    joined back, so that a hub with very many links is never gathered in one task. Ids without an
    edge do not occur in the result.
    """
    e = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    )
    e = written(e.distinct(), "edges")
    while not _stars(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (
            both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        large, old = written(large, "large_star"), e
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        e = written(small.union(lowest.select("a", F.col("low").alias("b"))).distinct(), "small_star")
        discard(old, large)
    members = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each larger end of the edges has one smaller neighbour, which is no larger end itself."""
    up = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = e.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = up.union(down).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.agg(F.count_if(F.expr("up > 1 or up = 1 and down = 1"))).first()[0] == 0


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once: a lambda's argument is not computed for each use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns: whatever else a table holds cannot clash with working columns."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
