"""Vectors as columns and as numpy blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for vectors that are neither null nor zero and hold only finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(df: DataFrame, v: str, *within: str) -> dict[int, int]:
    """Rows of each length of vector; with columns `within`, those of the largest group of each length.

    Vectors of different lengths cannot be compared, so a table is searched length by length. Lengths
    are those of the models behind a table, a handful, and are all that reaches the driver.
    """
    per = df.groupBy(F.size(v).alias("dim"), *within).count()
    return {r["dim"]: r["n"] for r in per.groupBy("dim").agg(F.max("count").alias("n")).collect()}


def by_length(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of vector in a block of rows with the numbers of its rows."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(n):
        yield int(dim), np.flatnonzero(n == dim)


def block(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal-length lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
