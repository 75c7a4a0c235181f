"""Vectors from array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has only finite components and is not zero."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(as_double, lambda x: x != 0), F.lit(False))


def vector_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id``, ``embedding`` (array of double) of the rows whose key is not null and whose vector is usable."""
    return (df.where(F.col(key).isNotNull() & usable(F.col(vector)))
            .select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists are all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))
