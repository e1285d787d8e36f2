"""Unit vectors from an embedding column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def clean(frame: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vec) of the rows with an id and a usable vector: finite numbers, of the table's usual length, not all zero.

    The usual length is the most frequent one, the longer of two as frequent. Repeated rows with one id are one; of
    different vectors with one id, the least counts.
    """
    numbers = frame.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")
    )
    usable = numbers.where(
        "v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
        " and exists(v, x -> x != 0)"
    )
    usual = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return usable.select("id", F.col("v").alias("vec"))
    return usable.where(F.size("v") == usual["d"]).groupBy("id").agg(F.min("v").alias("vec"))


def matrix(column: pa.Array | np.ndarray, dim: int | None = None) -> np.ndarray:
    """(rows, dimensions) unit vectors."""
    if isinstance(column, pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False)
        rows = np.asarray(flat, np.float64).reshape(len(column), -1)
    else:
        rows = np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, dim or 1))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
