"""Unions and differences of datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_common(parts: list[DataFrame]) -> DataFrame:
    """All rows on the columns that every part has, in the first one's order, with dataset_index."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    tagged = [p.select(F.lit(i).alias("dataset_index"), *common) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows on all columns, null where a part lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_and_extra(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one of the two has."""
    one = expected.join(found, key, "left_anti").select(key, F.lit("missing").alias("side"))
    return one.unionByName(found.join(expected, key, "left_anti").select(key, F.lit("extra").alias("side")))


def common_steps(left: DataFrame, right: DataFrame, step: str) -> DataFrame:
    """Steps that both have, and 0 if the right has it."""
    return left.intersect(right).union(right.filter(F.col(step) == 0)).distinct()


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
