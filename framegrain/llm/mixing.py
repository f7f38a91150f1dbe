"""Operator 1: mixing sources to target weights.

Every document gets an exponential key -ln(u)/w (Efraimidis and Spirakis), w being its quality weight and
u a uniform number derived from its id. A source whose target exceeds its size is taken in complete epochs
first; what is left of the target goes to the documents with the smallest keys, by a prefix sum of sizes.

The prefix sum has several levels. Sizes are summed by (source, key bin), the bin in which the budget ends is
found for each source, and that bin's range of keys is cut into bins again until it holds few rows: no task
sorts a source, whatever the weights do to its keys. Rows alike in key, id and size are one entry; which of
them are taken is arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framegrain.llm.common import SEED, n_words, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Bins of a level, and rows of a source's last bin that are sorted.
BINS = 1_024
EDGE_ROWS = 100_000
#: Characters that lower a document's weight.
_NOISE = "0123456789#*$%&|<>!@^~_=+{}[]\\/"


def quality_weight(text: Column) -> Column:
    """1 minus the share of digits and symbols, at least 0.05; 1 for empty and null texts."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(0.05), F.length(F.translate(text, _NOISE, "")) / n)).otherwise(F.lit(1.0))


def uniform(id_col: Column, seed: int = SEED) -> Column:
    """In (0, 1), from 52 bits of md5 over seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources take the weights in turn by code point, null last. Targets are min(cap * size, rate * weight)
    with the rate at which they add up to share * total: that is where repeated resharing ends. Sources are
    ordered by the rate at which they fill up; the rate is the first one that the next source still bears.
    The window runs over one row for each source.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    k = len(weights)
    turn = (F.row_number().over(by_name) - 1) % k
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("_w"), (F.lit(cap) * F.col("source_size")).alias("_cap"))
    filling = W.orderBy((F.col("_cap") / F.col("_w")), F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.select(
        "*", F.row_number().over(filling.rowsBetween(W.unboundedPreceding, 0)).alias("_nth"), F.coalesce(F.sum("_cap").over(filling), F.lit(0.0)).alias("_full"), F.coalesce(F.sum("_w").over(filling), F.lit(0.0)).alias("_used"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("_total"), F.sum("_w").over(everything).alias("_all"),
    )
    t = t.withColumn("_rate", (F.col("_total") - F.col("_full")) / (F.col("_all") - F.col("_used")))
    borne = F.when(F.col("_rate") <= F.col("_cap") / F.col("_w"), F.struct("_nth", "_rate"))
    t = t.withColumn("_at", F.min(borne).over(everything)["_rate"])
    return t.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _borders(base: DataFrame, plan: DataFrame, edge_rows: int) -> DataFrame:
    """(cut_source, lo, hi, before): the range of keys [lo, hi] in which a source's budget ends and the sizes below it.

    Each level sums sizes by equal parts of the range, of 1 - exp(-key) first and of the key then, and goes on
    with the part that holds the end. It ends when such a part has few rows or keys that are all alike.
    """
    spread = base.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    found = plan.join(spread.withColumnRenamed("source", "_s"), _same("source", "_s")).select(F.col("source").alias("cut_source"), "lo", "hi", F.lit(0).cast("long").alias("before"), "budget")
    part = F.floor(F.lit(BINS) * (1 - F.exp(-F.col("key"))))
    while True:
        rows = base.join(found, _same("source", "cut_source")).filter((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
        bins = rows.withColumn("bin", F.least(part, F.lit(BINS - 1)).cast("int")).groupBy("cut_source", "bin", "before", "budget")
        bins = bins.agg(F.sum("size").alias("bin_size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        upto = F.col("before") + F.sum("bin_size").over(W.partitionBy("cut_source").orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        at = bins.withColumn("before", upto - F.col("bin_size")).filter((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("bin_size")))
        found = written(at.select("cut_source", "lo", "hi", "before", "budget", "n"), "mix-range")
        if found.filter((F.col("n") > edge_rows) & (F.col("lo") < F.col("hi"))).isEmpty():
            return found.drop("n", "budget")
        part = F.when(F.col("hi") > F.col("lo"), F.floor(F.lit(BINS) * (F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")))).otherwise(F.lit(0))


def _numbered_alike(rows: DataFrame) -> DataFrame:
    """rows with `nth`, from 0 within their source, in order of their task and place: counts by task are summed, rows stay."""
    placed = written(rows.withColumn("_m", F.monotonically_increasing_id()), "mix-alike").withColumn("_t", F.shiftright("_m", 33))
    tasks = placed.groupBy("source", "_t").agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("source").orderBy("_t").rowsBetween(W.unboundedPreceding, 0)
    tasks = tasks.select(F.col("source").alias("_s"), F.col("_t").alias("_u"), (F.sum("_n").over(order) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("source", "_t").orderBy("_m")) - 1
    return placed.join(tasks, _same("source", "_s") & (F.col("_t") == F.col("_u"))).withColumn("nth", F.col("_before") + inside).drop("_m", "_t", "_s", "_u", "_before")


def mix(df: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP, seed: int = SEED, weight: Column | None = None,
        id_col="doc_id", text_col="text", source_col="source", keep: tuple[str, ...] = (), edge_rows: int = EDGE_ROWS) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, copies, taken and the columns in `keep`.

    Null and blank texts have size 0 and are never taken. Null is a source of its own, last in order. The
    last document of the partial pass enters when at least half of it fits, so a source misses its target
    by half a document at most. Rows of equal id share one random number and are ordered by size; of rows
    alike in both, as many are taken as fit. An empty input gives an empty result.
    """
    text = F.col(text_col)
    w = quality_weight(text) if weight is None else weight
    base = written(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text).alias("size"), w.cast("double").alias("weight"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
        .withColumn("key", -F.ln(uniform(F.col("doc_id"), seed)) / F.col("weight")),
        "mix",
    )
    kept = [F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)]
    narrow = base.select("source", "key", "doc_id", "size")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    plan = targets.select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long").alias("epochs"),
    ).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = written(plan, "mix-targets")
    ranges = _borders(narrow, plan, edge_rows)
    plan = plan.join(ranges, _same("source", "cut_source"), "left").drop("cut_source")
    # In the last range, documents in order; the last of them that enters, and how many of the rows alike do.
    inside = narrow.join(plan.select(F.col("source").alias("plan_source"), "lo", "hi", "before", "budget"), _same("source", "plan_source")).filter((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
    entries = inside.groupBy("source", "key", "doc_id", "size", "before", "budget").agg(F.count(F.lit(1)).alias("n"))
    mass = F.col("size") * F.col("n")
    order = W.partitionBy("source").orderBy("key", F.asc_nulls_last("doc_id"), "size").rowsBetween(W.unboundedPreceding, 0)
    entries = entries.withColumn("start", F.col("before") + F.sum(mass).over(order) - mass)
    left = 2 * F.col("budget") - 2 * F.col("start") - F.col("size")
    entries = entries.filter(left >= 0).withColumn("fit", F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(left / (2 * F.col("size"))).cast("long") + 1)).otherwise(F.col("n")))
    place = F.struct("key", F.col("doc_id").isNull().alias("none"), "doc_id", "size")
    last = entries.groupBy("source").agg(F.max(F.struct(place.alias("place"), "fit", "n")).alias("last")).select(F.col("source").alias("cut_source"), "last")
    plan = written(plan.join(last, _same("source", "cut_source"), "left").drop("cut_source").withColumnRenamed("source", "plan_source"), "mix-plan")
    rows = base.join(plan, _same("source", "plan_source")).drop("plan_source").withColumn("at", place)
    # Without a range, a source that fills its budget exactly has it in full epochs and takes no more.
    first = F.when(F.col("lo").isNull(), False).when(F.col("last").isNull(), F.col("key") < F.col("lo")).otherwise(F.col("at") <= F.col("last.place"))
    rows = rows.withColumn("extra", first)
    split = F.coalesce((F.col("at") == F.col("last.place")) & (F.col("last.fit") < F.col("last.n")), F.lit(False))
    alike = _numbered_alike(rows.filter(split)).withColumn("extra", F.col("nth") < F.col("last.fit")).drop("nth")
    out = rows.filter(~split).unionByName(alike).withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("extra").cast("long")).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *kept)


def op1_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}.0)
         / CASE WHEN length(text) > 0 THEN greatest(0.05, length(translate(text, '{_NOISE}', ''))::DOUBLE / length(text)) ELSE 1.0 END AS k
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT source, n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM s),
f AS (
  SELECT source, n, w, 2 * n AS cap, row_number() OVER o AS nth,
         (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS rate
  FROM w WINDOW o AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, least(cap, coalesce((SELECT arg_min(rate, nth) FROM f WHERE rate <= cap / w) * w, cap)) AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, t.n, t.target, CASE WHEN t.n > 0 THEN floor(t.target / t.n) ELSE 0 END AS epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       CASE WHEN size > 0 THEN (epochs + CASE WHEN 2 * b + size <= 2 * (target - epochs * n) THEN 1 ELSE 0 END)::BIGINT * size ELSE 0 END::BIGINT AS taken
FROM p
"""
