"""Vectors packed into blocks of bounded size: one row holds a few thousand vectors as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 21


def usable(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components; null vectors are not usable."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def block_rows(width: int) -> int:
    """Vectors in a block, so that it has at most BLOCK_BYTES."""
    return max(16, BLOCK_BYTES // (8 * max(1, width)))


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Lists of numbers as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(column), width), kind)
    lengths = column.value_lengths().to_numpy()
    if len(column) and lengths.sum():
        rows = np.repeat(np.arange(len(column)), lengths)
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[rows, np.arange(len(rows)) - first] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def pack(
    df: DataFrame, width: int, keys: list[str], make: Callable[[np.ndarray, dict[str, np.ndarray]], dict], schema: str
) -> DataFrame:
    """Rows in their order as blocks: block, the ``keys`` and what ``make`` says of each.

    A block holds neighbours of one partition with equal ``keys``. ``make`` gets the matrix of column
    ``vector`` and the other columns as arrays, and returns the values of one row.
    """
    limit = block_rows(width)
    typed = StructType.fromDDL(f"block bigint, {schema}")
    names = to_arrow_schema(typed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out(batch: pa.Table) -> pa.RecordBatch:
            nonlocal n
            columns = {c: batch.column(c).to_numpy() for c in batch.column_names if c != "vector"}
            row = make(matrix(batch.column("vector").combine_chunks(), width), columns)
            row |= {"block": part * (1 << 32) + n} | {k: columns[k][0].item() for k in keys}
            n += 1
            return pa.RecordBatch.from_pylist([row], schema=names)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while True:
                size = min(limit, table.num_rows)
                for k in keys:
                    values = table.column(k).slice(0, size).to_numpy()
                    changed = np.flatnonzero(values != values[0])
                    size = int(changed[0]) if len(changed) else size
                if size == table.num_rows:  # the rest may go on in the next batch
                    break
                yield out(table.slice(0, size))
                table = table.slice(size)
            held = table.combine_chunks().to_batches() if table.num_rows else []
        if held:
            yield out(pa.Table.from_batches(held))

    return df.mapInArrow(run, typed)
