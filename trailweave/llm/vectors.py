"""Vectors of a table as arrays, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that take part: of some length, without null or non-finite components, not zero.
USABLE = """embedding IS NOT NULL AND size(embedding) > 0
    AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))
    AND exists(embedding, x -> x <> 0)"""


def usable(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.expr(USABLE), F.lit(False)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    if not n:
        return np.empty((0, 0))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of equal number in double precision, each pair summed in the same order."""
    return np.sum(a * b, axis=1) / (np.sqrt(np.sum(a * a, axis=1)) * np.sqrt(np.sum(b * b, axis=1)))
