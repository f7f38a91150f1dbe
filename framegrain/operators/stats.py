"""Per-channel statistics of vector columns, their merge, and normalisation with them.

Long form is (key, channel, value); a vector column is exploded with its positions, so any number of
channels aggregates with partial aggregation and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def channels(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("channel", "value")).withColumn("value", F.col("value").cast("double"))


def channel_stats(df: DataFrame, vector: str, keys: list[str]) -> DataFrame:
    """(keys, channel, n, min, max, mean, std): population standard deviation."""
    v = F.col("value")
    return channels(df, vector, keys).groupBy(*keys, "channel").agg(
        F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def merged_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of parts to those of the whole: weighted mean, and variance of the parts and between them."""
    n, mean = F.col("n"), F.col("mean")
    total = F.sum(n)
    whole = F.sum(n * mean) / total
    square = F.sum(n * (F.col("std") * F.col("std") + mean * mean)) / total
    return stats.groupBy(*keys, "channel").agg(
        total.alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), whole.alias("mean"), F.sqrt(F.greatest(square - whole * whole, F.lit(0.0))).alias("std")
    )


def vector_of(stats: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One array a key: the column in order of channels."""
    pairs = F.array_sort(F.collect_list(F.struct("channel", column)))
    return stats.groupBy(*keys).agg(F.transform(pairs, lambda p: p[column]).alias(column))


def constant_channels(stats: DataFrame, span: float = EPS) -> DataFrame:
    return stats.filter(F.col("max") - F.col("min") < span)


def out_of_range(df: DataFrame, vector: str, keys: list[str], stats: DataFrame, slack: float = 1e-6) -> DataFrame:
    """(keys, below, above, channels): values outside a channel's range, and the channels that have any."""
    rows = channels(df, vector, keys).join(stats.select("channel", "min", "max"), "channel")
    low, high = F.col("value") < F.col("min") - slack, F.col("value") > F.col("max") + slack
    return rows.groupBy(*keys).agg(
        F.sum(low.cast("long")).alias("below"), F.sum(high.cast("long")).alias("above"), F.array_sort(F.collect_set(F.when(low | high, F.col("channel")))).alias("channels")
    )


def _each(vector, *arrays, f) -> Column:
    arrays = [F.array(*[F.lit(float(x)) for x in a]) if isinstance(a, (list, tuple)) else a for a in arrays]
    return F.transform(vector, lambda x, i: f(x.cast("double"), *[F.get(a, i) for a in arrays]))


def scale_minmax(vector, low, high, symmetric: bool = True) -> Column:
    """To [-1, 1] or [0, 1]; values outside the range stay outside."""
    to = (lambda x: 2 * x - 1) if symmetric else (lambda x: x)
    return _each(vector, low, high, f=lambda x, a, b: to((x - a) / (b - a)))


def unscale_minmax(vector, low, high) -> Column:
    return _each(vector, low, high, f=lambda x, a, b: 0.5 * (x + 1) * (b - a) + a)


def standardise(vector, mean, std) -> Column:
    return _each(vector, mean, std, f=lambda x, m, s: (x - m) / (s + EPS))


def unstandardise(vector, mean, std) -> Column:
    return _each(vector, mean, std, f=lambda x, m, s: x * s + m)


def widened(stats: Column, at: int, width: int, fixed: float) -> Column:
    """Statistics of a vector whose channels [at, at + 3) become `width` channels with a fixed value."""
    return F.concat(F.slice(stats, 1, at), F.array_repeat(F.lit(fixed), width), F.slice(stats, at + 4, F.greatest(F.size(stats) - at - 3, F.lit(0))))


def delta_scale(df: DataFrame, columns: dict[str, float], share: float = 0.99) -> DataFrame:
    """One row: the share-quantile of each column's absolute value, at least its floor."""
    return df.agg(*[F.greatest(F.percentile(F.abs(F.col(c)), share), F.lit(floor)).alias(c) for c, floor in columns.items()])


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1.0))


def stats_agree(left: DataFrame, right: DataFrame, keys: list[str], column: str, atol: float, rtol: float = 0.0) -> DataFrame:
    """Channels whose statistic differs by more than atol + rtol * |right|, or that one side lacks."""
    a, b = left.select(*keys, F.col(column).alias("left_value")), right.select(*keys, F.col(column).alias("right_value"))
    off = F.abs(F.col("left_value") - F.col("right_value")) > atol + rtol * F.abs(F.col("right_value"))
    return a.join(b, keys, "full_outer").filter(off | F.col("left_value").isNull() | F.col("right_value").isNull())


def image_stats(images: DataFrame, frame: str, pixels: str) -> DataFrame:
    """(channel, n, mean, std) from sums and squares over 0..255 pixels as (frame, [channel][pixel]) arrays."""
    rows = images.select(frame, F.posexplode(pixels).alias("channel", "plane")).select(frame, "channel", F.explode("plane").alias("v"))
    x = F.col("v") / 255.0
    return rows.groupBy("channel").agg(F.countDistinct(frame).alias("n"), F.avg(x).alias("mean"), F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0))).alias("std"))


def sketches(df: DataFrame, value: str, keys: list[str], size: int = 200) -> DataFrame:
    """(keys, n, sketch): a quantile sketch of each group as a binary column, to be kept in a table of statistics and merged later.

    A rank is off by about 1.7 / size of a group's rows at most, with 99% confidence; a group of up to `size` values is exact.
    Nulls and NaN are left out.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged_quantiles(partial: DataFrame, keys: list[str], quantiles: dict[str, float], size: int = 200) -> DataFrame:
    """(keys, n, one column a quantile) of the sketches of each group: the smallest value with at least that share of values up to it."""
    merged = partial.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("_s"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(q))).alias(name) for name, q in quantiles.items()])


def value_counts(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, n): how often each value is there, to be kept in a table of statistics and merged later without loss. Nulls and NaN are left out."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def counted_quantiles(partial: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys, n, one column a quantile) of tables of `value_counts`, exact: the smallest value with at least that share of values up to it.

    Counts add up in ranges of keys and values, so no task meets a key's values.
    """
    from framegrain.operators.ranges import prefixed

    per = prefixed(partial.groupBy(*keys, value).agg(F.sum("n").alias("_n")), [*keys, value], {"n": F.col("_n")})
    spans = per.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("before_n").alias("_from"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    rows = per.alias("l").join(spans.alias("r"), same).select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"l.{value}").alias("_v"), "n", (F.col("before_n") - F.col("_from") + F.col("_n")).alias("_upto"))
    at = lambda q: F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.lit(float(q)) * F.col("n")), F.lit(1)), F.col("_v")))
    return rows.groupBy(*keys, "n").agg(*[at(q).alias(name) for name, q in quantiles.items()])
