"""Shared handling of embedding tables: valid vectors, exact copies, Arrow conversion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stored


def is_valid(vector: Column) -> Column:
    """No null, no component that is null or not finite, not zero and not empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_size(vectors: DataFrame) -> int:
    """The most frequent number of components (ties: the smaller); 0 without vectors."""
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), "d").first()
    return first["d"] if first else 0


def prepared(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """Stored ``vec_id, vector, ok, h1, h2`` rows and the number of components.

    ``ok`` rows take part: valid vectors of the usual size.  ``h1, h2`` are 128 bits of the vector.
    """
    vector = embeddings["embedding"].cast("array<double>")
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), vector.alias("vector"))
    size = usual_size(rows.where(is_valid(F.col("vector"))))
    ok = is_valid(F.col("vector")) & (F.size("vector") == size)
    rows = rows.withColumn("ok", ok).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    return stored(rows.select("vec_id", F.when(F.col("ok"), F.col("vector")).alias("vector"), "ok", "h1", "h2"), "vectors"), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column without nulls whose lists have ``size`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; large and small components are scaled first, so no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def packed(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def unpacked(values: np.ndarray, kind, size: int) -> np.ndarray:
    """The matrix of an object array of binary values."""
    return np.frombuffer(b"".join(values), kind).reshape(-1, size)
