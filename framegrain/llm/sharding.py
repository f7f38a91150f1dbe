"""Operator 6: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get gapless numbers 0..n-1, the numbers are permuted by a keyed Feistel network over the smallest
power of two that holds n (values of n and above walk on along their cycle), and the permuted number p
gives shard p mod S and slot p div S: counts differ by one at most, slots have no gaps, and both the shard
of a row and the row of a (shard, slot) can be computed without a lookup (`permuted`, `restored`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framegrain.llm.common import SEED

ROUNDS = 8
#: Steps along a cycle that one expression allows. Each step stays outside with a chance below one half.
WALK = 96
#: Copies of one row that one task makes at most.
ALIKE_ROWS = 10_000


def _digits(*parts: Column, hexes: int = 15) -> Column:
    """A whole number of 4 * hexes bits from md5 over the parts' text; null parts are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, hexes), 16, 10).cast("long")


def _rounds(x: Column, bits: int, seed: int, order: list[int]) -> Column:
    low = bits // 2
    high = bits - low
    mask_low, mask_high = (1 << low) - 1, (1 << high) - 1

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        noise = _digits(F.lit(seed), i, F.when(even, s["h"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, s["l"].bitwiseXOR(noise.bitwiseAND(F.lit(mask_low)))).otherwise(s["l"]).alias("l"),
            F.when(even, s["h"]).otherwise(s["h"].bitwiseXOR(noise.bitwiseAND(F.lit(mask_high)))).alias("h"),
        )

    start = F.struct(x.bitwiseAND(F.lit(mask_low)).cast("long").alias("l"), F.shiftright(x, low).cast("long").alias("h"))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda s: F.shiftleft(s["h"], low).bitwiseOR(s["l"]))


def _walked(x: Column, n: int, seed: int, order: list[int]) -> Column:
    if n <= 1:
        return x.cast("long")
    bits = max(2, math.ceil(math.log2(n)))
    once = lambda v: _rounds(v, bits, seed, order)
    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x.cast("long")), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def permuted(row: Column, n: int, seed: int = SEED) -> Column:
    """Place of row number `row` (0..n-1) in the shuffled order."""
    return _walked(row, n, seed, list(range(ROUNDS)))


def restored(place: Column, n: int, seed: int = SEED) -> Column:
    """Row number at `place`; shard s and slot t hold place t * shards + s."""
    return _walked(place, n, seed, list(range(ROUNDS))[::-1])


def numbered(df: DataFrame, keys: list[str], bucket_rows: int = 50_000) -> tuple[DataFrame, int]:
    """`keys` with a gapless `row` number, ordered by hash bucket and then by key; and the number of rows.

    Rows that are equal in all keys are counted together before anything is sorted, so a repeated row,
    however frequent, is one entry of its bucket. The only global window is over one row for each bucket.
    """
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    n = df.count()
    buckets = max(1, math.ceil(n / bucket_rows))
    groups = groups.withColumn("_b", F.pmod(_digits(*[F.col(k) for k in keys]), F.lit(buckets)))
    totals = groups.groupBy("_b").agg(F.sum("_c").alias("_t"))
    starts = totals.select("_b", (F.sum("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_t")).alias("_s"))
    within = W.partitionBy("_b").orderBy(*[F.asc_nulls_first(k) for k in keys])
    placed = groups.withColumn("_o", F.sum("_c").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).join(starts, "_b")
    span = lambda low, high: F.explode(F.sequence(low, high))
    few = placed.filter(F.col("_c") <= ALIKE_ROWS).withColumn("_k", span(F.lit(0).cast("long"), F.col("_c") - 1))
    # Copies of one row are made by several tasks, a part of them each.
    parts = placed.filter(F.col("_c") > ALIKE_ROWS).withColumn("_p", span(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / ALIKE_ROWS)))
    parts = parts.repartition(F.col("_p"), *[F.col(k) for k in keys])
    many = parts.withColumn("_k", span(F.col("_p") * ALIKE_ROWS, F.least(F.col("_c"), (F.col("_p") + 1) * ALIKE_ROWS) - 1))
    return few.unionByName(many.drop("_p")).select(*keys, (F.col("_s") + F.col("_o") + F.col("_k")).alias("row")), n


def shard(df: DataFrame, shards: int = 24, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, size (UTF-8 bytes + 8), text_crc32, row, shard, slot.

    Null text: size 8, crc32 of the empty text. Null ids are numbered first in their bucket. Repeated rows
    each get a place of their own. An empty input gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])
    place = permuted(F.col("row"), n, seed)
    return rows.withColumn("_p", place).select(
        "doc_id", "size", "text_crc32", "row",
        (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"),
    )


def op6_sharding(spark, sf_dir):
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def _sql(shards: int = 24, seed: int = SEED, bucket_rows: int = 50_000) -> str:
    """The whole query as DuckDB SQL: the rows' numbers, then the rounds as nested selects and the walk as a recursion."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    number = lambda text: f"('0x' || substr(md5({text}), 1, 15))::BIGINT"
    rounds = "SELECT row, n, low, mask_low, mask_high, v & mask_low AS l, v >> low AS h FROM {source}"
    for i in range(ROUNDS):
        noise = number(f"'{seed}:{i}:' || {'h' if i % 2 == 0 else 'l'}")
        halves = f"xor(l, {noise} & mask_low) AS l, h" if i % 2 == 0 else f"l, xor(h, {noise} & mask_high) AS h"
        rounds = f"SELECT row, n, low, mask_low, mask_high, {halves} FROM ({rounds})"
    step = f"SELECT row, n, low, mask_low, mask_high, (h << low) | l AS v FROM ({rounds})"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, octet_length(encode(t)) + 8 AS size, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
k AS MATERIALIZED (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32, count(*) OVER () AS n FROM b),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {number("concat_ws(':', doc_id, size, text_crc32)")} % ceil(n / {bucket_rows}.0)::BIGINT, doc_id NULLS FIRST, size, text_crc32) - 1 AS row FROM k),
s AS (SELECT row, n, row AS v, bits // 2 AS low, (1::BIGINT << (bits // 2)) - 1 AS mask_low, (1::BIGINT << (bits - bits // 2)) - 1 AS mask_high FROM (SELECT *, greatest(2, ceil(log2(n)))::BIGINT AS bits FROM r)),
w AS ({step.format(source="s")} UNION ALL {step.format(source="(SELECT * FROM w WHERE v >= n) AS w")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards})::INTEGER AS shard, v // {shards} AS slot, NULL::INTEGER AS grown_shard, row FROM r JOIN (SELECT row, v FROM w WHERE v < n) USING (row)"""


OP6_SQL = _sql()
