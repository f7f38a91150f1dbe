"""Table functions for SQL, registered by `register`."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="start int, position int, value double, is_pad boolean")
class Chunks:
    """chunks(series, size, stride): windows of `size` values from every `stride`-th on; past the end the last value repeats.

    A null or empty series has no chunks; null values stay null.
    """

    def eval(self, series, size: int, stride: int):
        if size < 1 or stride < 1:
            raise ValueError("size and stride must be at least 1")
        last = len(series or []) - 1
        for start in range(0, last + 1, stride):
            for k in range(size):
                yield start, k, series[min(start + k, last)], start + k > last


def register(spark: SparkSession) -> None:
    """Makes `chunks` usable in SQL, as in SELECT ... FROM t, LATERAL chunks(t.series, 16, 8)."""
    spark.udtf.register("chunks", Chunks)
