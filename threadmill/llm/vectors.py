"""What the operators on embeddings share: usable vectors, and the exact measure.

A vector takes part when it is not null or empty, holds only finite numbers,
and is not all zeros.  Rows without an id take no part; of rows with one id,
the smallest vector takes part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_id(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): one row per id."""
    return (df.where(F.col(id_col).isNotNull())
            .groupBy(F.col(id_col).cast("bigint").alias("id"))
            .agg(F.min(F.col(vec_col).cast("array<double>")).alias("vec")))


def usable(vec: str = "vec") -> Column:
    whole = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & whole & F.exists(F.col(vec), lambda x: x != 0)


def matrix(column) -> np.ndarray:
    """Rows of equal length, as float64."""
    return np.array([np.asarray(v, np.float64) for v in column], np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first divided by their largest part, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; equal rows always give equal values."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
