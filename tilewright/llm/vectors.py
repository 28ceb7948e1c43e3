"""Vectors of a table as bytes, in numpy.

Vectors that can't be compared become null: null, empty, zero, or with a null or non-finite
component; so do those of null ids. Repeated rows stay rows of their own, other columns are
ignored, and an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def component_type(df: DataFrame, column: str = "embedding") -> str:
    """numpy's name for the components' type."""
    return "<f8" if isinstance(df.schema[column].dataType.elementType, T.DoubleType) else "<f4"


def as_bytes(df: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, vec: the components' bytes (-0.0 as 0.0), or null for vectors that can't be compared.

    Those are null, empty or zero, or hold a null or non-finite component, or have no vec_id.
    """
    kind = component_type(df, column)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            good = (bad[ends[1:]] == bad[ends[:-1]]) & (some[ends[1:]] > some[ends[:-1]])
            good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            vec = [values[a:b].tobytes() if ok else None for a, b, ok in zip(ends, ends[1:], good)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], [key, "vec"])

    return df.select(F.col(key).cast("bigint"), column).mapInArrow(run, f"{key} bigint, vec binary")


def matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one size as rows, in double precision."""
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))
