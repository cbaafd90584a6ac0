"""Vectors in blocks of rows, and their components as exact integers.

A block holds the rows of one length that stood together in an Arrow batch, at most
``BLOCK`` of them. Iterative operators read blocks again in each round, from Parquet in the
shared scratch folder, so a lost executor costs one read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from kinelake.llm.scratch import map_batches

BLOCK = 4096
#: Below this, sums and products of integers in float64 are exact in any order.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def finite(v: Column) -> Column:
    """The vector and all its components are there and finite."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def blocks(vectors: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """(d, ids, v): blocks of the finite vectors, of ``length`` components where that is given; v has the components' bytes."""
    kind = vectors.schema[vector_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(f"`{vector_col}`")
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)):
        v = v.cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(finite(F.col("v")))
    if length is not None:
        rows = rows.where(F.size("v") == length)

    def run(batches):
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for a in range(0, len(at), BLOCK):
                    some = batch.take(pa.array(at[a : a + BLOCK]))
                    values = some.column(1).flatten().to_numpy(zero_copy_only=False)
                    ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), ids, pa.array([values.tobytes()], pa.binary())], ["d", "ids", "v"])

    return map_batches(rows, run, "d int, ids array<long>, v binary").withMetadata("v", {"float": "f4" if narrow else "f8"})


def component_type(blocks: DataFrame) -> str:
    """The numpy type of the blocks' components."""
    return blocks.schema["v"].metadata["float"]


def matrix(raw: bytes, d: int, kind: str) -> np.ndarray:
    """A block's components as float64 rows."""
    values = np.frombuffer(raw, dtype=kind).astype(np.float64)
    return values.reshape(-1, d) if d else np.zeros((0, 0))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * v) for a power of two ``scale``: float64 where every result is below 2^53, Python integers otherwise."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if np.abs(scaled).max(initial=0) < EXACT:
        return scaled
    whole = [int(s) if np.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel(), values.ravel(), strict=True)]
    return as_objects(whole).reshape(values.shape)


def as_objects(values) -> np.ndarray:
    """Python integers in an object array."""
    out = np.empty(len(values), dtype=object)
    out[:] = [int(v) for v in values]
    return out


def column_sums(rows: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of integers, as Python integers."""
    if rows.dtype != object and len(rows) * np.abs(rows).max(initial=0) < EXACT:
        return as_objects(rows.sum(axis=0))
    return sum((as_objects(r) for r in rows), np.zeros(rows.shape[1], dtype=object))
