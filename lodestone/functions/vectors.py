"""Vectors as bytes: little-endian 32-bit floats, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded(vector: Column) -> Column:
    """Null vectors are null; values beyond the range become infinite."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f8").astype("<f4").tobytes())

    return run(vector)


def decoded(data: Column, dimension: Column) -> Column:
    """Null bytes are null; a length that is not 4 * dimension is an error of the whole query."""

    @F.pandas_udf("array<float>")
    def run(found: pd.Series, sizes: pd.Series) -> pd.Series:
        def one(raw: bytes | None, n: int) -> np.ndarray | None:
            if raw is None:
                return None
            if len(raw) != 4 * n:
                raise ValueError(f"a vector of {len(raw)} bytes has not the dimension {n}")
            return np.frombuffer(raw, "<f4")

        return pd.Series([one(x, n) for x, n in zip(found, sizes, strict=True)])

    return run(data, dimension)
