"""Comparison of two tables whose columns may be nested to any depth, compiled from their schema.

Every column type becomes one expression that gives a pair's largest absolute and relative error, the number of leaves that
differ, and whether lengths or keys differ. All columns are then one aggregate over one join of the tables on their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegrain.functions.geometry import bound

FLOATING = (T.FloatType, T.DoubleType)
RESULT = "column string, issue string, rows long, different long, leaves long, max_abs double, max_rel double, first_key string"


def _found(absolute, relative, leaves, shape) -> Column:
    return F.struct(absolute.cast("double").alias("abs"), relative.cast("double").alias("rel"), leaves.cast("long").alias("leaves"), shape.cast("boolean").alias("shape"))


def _none() -> Column:
    return _found(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(False))


def _both(x: Column, y: Column) -> Column:
    return _found(F.greatest(x["abs"], y["abs"]), F.greatest(x["rel"], y["rel"]), x["leaves"] + y["leaves"], x["shape"] | y["shape"])


def difference(kind: T.DataType, expected: Column, actual: Column, rtol: float, atol: float) -> Column:
    """struct(abs, rel, leaves, shape) of two values of one type.

    Floats are alike within atol + rtol * |expected|; two NaN are, and so are equal infinities. abs and rel are over finite
    pairs. A null is only like a null. Arrays of different lengths and maps of different keys differ in shape, and what they
    hold is not compared. All else is alike when it is equal.
    """
    alone = F.when(expected.isNull() & actual.isNull(), _none()).when(expected.isNull() | actual.isNull(), _found(F.lit(0.0), F.lit(0.0), F.lit(1), F.lit(False)))
    if isinstance(kind, FLOATING):
        def number(p: Column) -> Column:
            a, b = p["a"].cast("double"), p["b"].cast("double")
            finite = (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))  # NaN is above infinity in Spark
            gap = F.abs(b - a)
            close = F.when(finite, gap <= atol + rtol * F.abs(a)).otherwise(a == b)  # NaN equals NaN in Spark
            share = F.when(gap == 0, 0.0).when(a == 0, float("inf")).otherwise(gap / F.abs(a))
            return _found(F.when(finite, gap).otherwise(0.0), F.when(finite, share).otherwise(0.0), F.when(close, 0).otherwise(1), F.lit(False))

        return alone.otherwise(bound(F.struct(expected.alias("a"), actual.alias("b")), number))
    if isinstance(kind, T.StructType):
        out = _none()
        for f in kind.fields:
            out = _both(out, difference(f.dataType, expected.getField(f.name), actual.getField(f.name), rtol, atol))
        return alone.otherwise(bound(out, lambda x: x))
    if isinstance(kind, T.ArrayType):
        return alone.when(F.size(expected) != F.size(actual), _found(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(True))).otherwise(
            F.aggregate(F.zip_with(expected, actual, lambda x, y: difference(kind.elementType, x, y, rtol, atol)), _none(), _both)
        )
    if isinstance(kind, T.MapType):
        keys = lambda m: F.array_sort(F.map_keys(m))
        values = lambda m: F.transform(keys(m), lambda k: F.try_element_at(m, k))
        return alone.when(keys(expected) != keys(actual), _found(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(True))).otherwise(
            F.aggregate(F.zip_with(values(expected), values(actual), lambda x, y: difference(kind.valueType, x, y, rtol, atol)), _none(), _both)
        )
    return _found(F.lit(0.0), F.lit(0.0), F.when(expected.eqNullSafe(actual), 0).otherwise(1), F.lit(False))


def schema_issues(expected: T.StructType, actual: T.StructType, columns: list[str] | None = None) -> list[tuple[str, str]]:
    """(column, issue): columns that one side lacks, and those of another type or place."""
    mine, theirs = {f.name: f.dataType for f in expected.fields}, {f.name: f.dataType for f in actual.fields}
    chosen = columns or list(mine)
    out = [(c, "not in the expected table") for c in chosen if c not in mine]
    out += [(c, "missing") for c in chosen if c in mine and c not in theirs]
    out += [(c, f"type {theirs[c].simpleString()} in place of {mine[c].simpleString()}") for c in chosen if c in mine and c in theirs and mine[c] != theirs[c] and mine[c].simpleString() != theirs[c].simpleString()]
    if columns is None:
        out += [(c, "added") for c in theirs if c not in mine]
        both = [c for c in mine if c in theirs]
        order = [c for c in theirs if c in mine]
        out += [(a, f"in the place of {b}") for a, b in zip(order, both, strict=True) if a != b]
    return out


def compare_tables(expected: DataFrame, actual: DataFrame, keys: list[str], columns: list[str] | None = None, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """(column, issue, rows, different, leaves, max_abs, max_rel, first_key): one row for each column that both tables have with
    one type, and one for each issue of the schemas and of the keys.

    Rows meet on their keys, never by their place; null keys are keys. rows: pairs compared; different: pairs that are not
    alike; leaves: values in them that are not; first_key: the smallest key of such a pair, as JSON. A key that several rows of a
    side have is an issue and its pairs are all compared. Issues of keys have no column, and their number in `rows`.
    """
    spark = expected.sparkSession
    found = schema_issues(expected.schema, actual.schema, columns)
    wrong = {c for c, issue in found if not issue.startswith("in the place of")}
    chosen = [c for c in (columns or expected.columns) if c not in wrong and c not in keys]
    kinds = {c: expected.schema[c].dataType for c in chosen}
    side = lambda df, name: df.select(F.struct(*[F.col(f"`{k}`").alias(k) for k in keys]).alias(f"_k{name}"), F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`").alias(c) for c in chosen]).alias(name))
    left, right = side(expected, "a"), side(actual, "b")
    both = left.join(right, F.col("_ka").eqNullSafe(F.col("_kb")), "full_outer").withColumn("_key", F.coalesce("_ka", "_kb"))
    met = F.col("a").isNotNull() & F.col("b").isNotNull()
    each = both.select("_key", met.alias("_met"), F.col("a").isNull().alias("_more"), F.col("b").isNull().alias("_less"), *[F.when(met, difference(kinds[c], F.col(f"a.`{c}`"), F.col(f"b.`{c}`"), rtol, atol)).alias(f"d{i}") for i, c in enumerate(chosen)])
    parts = [F.count_if("_met").alias("_rows"), F.count_if("_more").alias("_extra"), F.count_if("_less").alias("_missing")]
    for i in range(len(chosen)):
        bad = F.col(f"d{i}.shape") | (F.col(f"d{i}.leaves") > 0)
        parts.append(F.struct(
            F.coalesce(F.count_if(bad), F.lit(0)).alias("different"), F.coalesce(F.sum(f"d{i}.leaves"), F.lit(0)).alias("leaves"), F.count_if(F.col(f"d{i}.shape")).alias("shapes"),
            F.max(f"d{i}.abs").alias("abs"), F.max(f"d{i}.rel").alias("rel"), F.min(F.when(bad, F.col("_key"))).alias("key"),
        ).alias(f"d{i}"))
    totals = each.agg(*parts)  # one row
    none = lambda kind: F.lit(None).cast(kind)
    line = lambda column, issue, rows, different, leaves, absolute, relative, key: F.struct(column.alias("column"), issue.alias("issue"), rows.alias("rows"), different.alias("different"), leaves.alias("leaves"), absolute.alias("max_abs"), relative.alias("max_rel"), key.alias("first_key"))
    rows = []
    for i, c in enumerate(chosen):
        d = F.col(f"d{i}")
        issue = F.when(d["shapes"] > 0, "shapes differ").when(d["different"] > 0, "values differ")
        rows.append(line(F.lit(c), issue, F.col("_rows"), d["different"], d["leaves"], d["abs"], d["rel"], F.to_json(d["key"])))
    for issue, n in (("rows missing", "_missing"), ("rows added", "_extra")):
        rows.append(line(none("string"), F.when(F.col(n) > 0, issue), F.col(n), none("long"), none("long"), none("double"), none("double"), none("string")))
    out = totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("column IS NOT NULL OR issue IS NOT NULL")
    repeated = None
    for df, name in ((expected, "expected"), (actual, "actual")):
        many = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0")
        many = many.select(none("string").alias("column"), F.lit(f"keys repeated in the {name} table").alias("issue"), "rows", *[none(k).alias(n) for n, k in (("different", "long"), ("leaves", "long"), ("max_abs", "double"), ("max_rel", "double"), ("first_key", "string"))])
        repeated = many if repeated is None else repeated.unionByName(many)
    out = out.unionByName(repeated)
    return out.unionByName(spark.createDataFrame([(c, issue, None, None, None, None, None, None) for c, issue in found], RESULT)) if found else out
