"""Vectors of embeddings as whole numbers, for operators that must agree exactly wherever they run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256.0


def usable(vector_col: str) -> Column:
    """Whether a row's vector is there, not empty, and all its components are finite numbers. Null counts as not."""
    v = F.col(f"`{vector_col}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(v) > 0) & F.forall(v.cast("array<double>"), finite), F.lit(False))


def vector_of(df: DataFrame, vector_col: str) -> Column:
    """The vector as floats or doubles."""
    kind = df.schema[vector_col].dataType
    v = F.col(f"`{vector_col}`")
    return v if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType) else v.cast("array<double>")


def bits(dims: int) -> int:
    """Whole components are kept within 2 ** bits either way, so that a squared distance over dims of them, or a hundred
    times a product, fits a long: 2 ** 25 for 64 components, which is a component of 131,072 before scaling."""
    return (62 - max(dims - 1, 1).bit_length()) // 2 - 3


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """Row by row, floor(256 * x) of each component as a long."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    most = float(2 ** bits(dims))
    return np.clip(np.floor(SCALE * values), -most, most).astype(np.int64).reshape(-1, dims)
