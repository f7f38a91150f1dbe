"""Whole-number vectors from an array column, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole_vectors(df: DataFrame, scale: int, shift: int = 0, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(vec_id, *keep, x) with x = floor(scale * entry) + shift as array<long>, and the number of dimensions.

    The longest vector without a null or non-finite entry sets the dimensions; a shorter one lacks entries, which count as
    null. Rows whose vector is null or has such an entry are left out. Entries beyond a long raise Spark's error.
    """
    sound = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.filter(F.col(vec_col).isNotNull() & sound)
    d = rows.agg(F.max(F.size(vec_col))).first()[0] or 0
    x = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))
    return rows.filter(F.size(vec_col) == d).select(F.col(id_col).cast("long").alias("vec_id"), *[F.col(c) for c in keep], x.alias("x")), d


def matrix(column, d: int) -> np.ndarray:
    """An Arrow list column without nulls as an array of shape (rows, d)."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
