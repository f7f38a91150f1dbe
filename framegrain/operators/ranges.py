"""Prefix sums over a whole table without a window over the whole table.

Rows fall into ranges of the ordering columns, as many as hold ROWS rows each; each range is summed up in a window of its
own, and the totals of the ranges before it are added. The one window over all ranges sees one row for each of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegrain.session import stored

#: Rows of a range, about.
ROWS = 500_000


def prefixed(df: DataFrame, order: list[str], sums: dict[str, Column], rows: int = ROWS) -> DataFrame:
    """df with before_{name}: the sum over all rows before in the order, which should be total. Nulls come first.

    All columns of `order` cut the ranges, so many rows alike in the first one are no hot range. A table of more than `rows`
    rows is written once, by range.
    """
    parts = math.ceil(df.count() / rows)
    values = df.withColumns({f"_v_{k}": c for k, c in sums.items()})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if parts > 1:
        values = stored(values.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    else:
        values = values.withColumn("_part", F.lit(0))
    upto = before(Window.partitionBy("_part").orderBy(*order))
    inside = values.withColumns({f"_s_{k}": F.coalesce(F.sum(f"_v_{k}").over(upto), F.lit(0)) for k in sums})
    if parts <= 1:
        return inside.select(*df.columns, *[F.col(f"_s_{k}").alias(f"before_{k}") for k in sums])
    totals = values.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    over = before(Window.orderBy("_part"))  # one row for each range
    ahead = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(over), F.lit(0)).alias(f"_o_{k}") for k in sums])
    return inside.join(ahead, "_part").select(*df.columns, *[(F.col(f"_s_{k}") + F.col(f"_o_{k}")).alias(f"before_{k}") for k in sums])


def running(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, rows: int = ROWS) -> DataFrame:
    """df with `number`, its place from 0 in the order, and before_{name}: the sum over all rows before. Nulls come first."""
    sums = sums or {}
    out = prefixed(df, order, {"_number": F.lit(1).cast("long"), **sums}, rows)
    return out.select(*df.columns, F.col("before__number").cast("long").alias("number"), *[f"before_{k}" for k in sums])
