"""Operator 4: exact deduplication over a log-structured merge index of content digests.

1. Memtables: each task gathers digests in memory and flushes sorted runs, one block for each digest prefix;
   a digest that repeats within a memtable is one entry of the run (best id, rows, rows at the best id).
2. Compaction: the blocks of a prefix meet and are merged; the smallest identifier of a digest survives
   under the order asked for. A digest has one entry for each run, so a hot text is no hot key.
3. Filter: a Bloom filter of the digests with two rows or more. Texts that it passes are read again and
   compared byte by byte with the text of their group's keeper; hot groups are salted there.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framegrain.llm.common import bloom_bits, bloom_hit, utf8, written

MEMTABLE_ROWS = 200_000
PREFIX_ROWS = 50_000
#: A digest with more rows than this share of the table is hot. Fewer than 1 / HOT_SHARE digests can be.
HOT_SHARE = 0.001
SALTS = 32


def normalised(text):
    """Lower-case A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _merge(digest: np.ndarray, rank: np.ndarray, rows: np.ndarray, at: np.ndarray):
    """Entries sorted by digest, one for each: smallest rank, all rows, and the rows that have that rank."""
    order = np.lexsort((rank, digest))
    digest, rank, rows, at = digest[order], rank[order], rows[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(digest))))
    best = rank[first]
    return digest[first], best, np.add.reduceat(rows, first), np.add.reduceat(np.where(rank == best[group], at, 0), first)


def flushed_runs(digests: DataFrame, prefixes: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """(prefix, digests, ranks, rows, at): a block of a sorted run for each prefix and flush. Columns d, r in."""
    bits = prefixes.bit_length() - 1

    def task(batches):
        import pyarrow as pa

        schema = pa.schema([("prefix", pa.int32()), ("digests", pa.binary()), ("ranks", pa.binary()), ("rows", pa.binary()), ("at", pa.binary())])

        def flush(held):
            d, r = (np.concatenate(x) for x in zip(*held, strict=True))
            d, r, n, at = _merge(d, r, np.ones(len(d), np.int64), np.ones(len(d), np.int64))
            lead = np.frombuffer(d.tobytes(), np.uint8).reshape(len(d), -1)
            second = lead[:, 1] if lead.shape[1] > 1 else np.uint8(0)
            prefix = ((lead[:, 0].astype(np.int32) << 8) | second) >> (16 - bits)
            cut = np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1])))
            for a, b in zip(cut, np.append(cut[1:], len(d)), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(prefix[a])], pa.int32()), *[pa.array([x[a:b].tobytes()], pa.binary()) for x in (d, r, n, at)]], schema=schema)

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                raw = b.column(0).to_pylist()
                held.append((np.array(raw, f"S{len(raw[0])}"), b.column(1).to_numpy(zero_copy_only=False)))
                size += b.num_rows
            if size >= memtable_rows:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return digests.select("d", "r").mapInArrow(task, "prefix int, digests binary, ranks binary, rows binary, at binary")


def compacted(runs: DataFrame, width: int) -> DataFrame:
    """The index: (d, best, n, n_best), sorted within each prefix."""
    def task(pdf):
        import pandas as pd

        d = np.frombuffer(b"".join(pdf.digests), f"S{width}")
        parts = [np.frombuffer(b"".join(pdf[c]), np.int64) for c in ("ranks", "rows", "at")]
        d, r, n, at = _merge(d, *parts)
        raw = d.tobytes()
        return pd.DataFrame({"d": [raw[i * width : (i + 1) * width] for i in range(len(d))], "best": r, "n": n, "n_best": at})

    return runs.groupBy("prefix").applyInPandas(task, "d binary, best long, n long, n_best long")


def exact_dedup(df: DataFrame, keep: str = "max", digest_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: which id of a group stays, "min" or "max"; a null id only where the group has no other. Of rows
    that repeat an id and its text exactly one stays. Null and empty texts form one group. An empty input
    gives an empty result; other columns are ignored. digest_bytes below 32 shortens the index key, so that
    tests reach the path for digests that collide: what differs in bytes is grouped by the text itself.
    """
    text = normalised(F.col(text_col))
    sign = -1 if keep == "max" else 1
    # Ids become ranks, smallest first; null ranks behind all others.
    rank = F.coalesce(F.col(id_col).cast("long") * sign, F.lit((1 << 63) - 1))
    narrow = written(
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), rank.alias("r")).withColumn("d", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha")),
        "digests",
    )
    total = narrow.count()
    prefixes = 1 << min(16, max(0, (total // PREFIX_ROWS).bit_length()))
    index = compacted(flushed_runs(narrow, prefixes), digest_bytes)
    groups = written(index.filter("n > 1"), "groups")

    same = _verified(df, groups, sign, digest_bytes, id_col, text_col, max(1000, int(total * HOT_SHARE)))
    odd = same.filter(~F.col("same"))
    if not odd.isEmpty():  # digests that collide: those groups by text
        return _by_text(narrow, df, sign, id_col, text_col)
    hot = F.col("n") > max(1000, int(total * HOT_SHARE))
    out = _salted_join(narrow, groups, hot, "left")
    mine = F.col("r") == F.coalesce(F.col("best"), F.col("r"))
    out = out.select("doc_id", "sha", "r", F.coalesce("best", "r").alias("best"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), mine.alias("mine"), F.coalesce("n_best", F.lit(1)).alias("n_best"))
    # Rows that repeat an id and its text: one number a digest is chosen while rows aggregate, and found again by number, which no two rows share.
    tied = written(out.filter(F.col("mine") & (F.col("n_best") > 1)).withColumn("number", F.monotonically_increasing_id()), "tied")
    chosen = tied.groupBy("sha").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("chosen"))
    tied = tied.join(chosen, "number", "left").withColumn("kept", F.col("chosen").isNotNull()).drop("number", "chosen")
    rest = out.filter(~(F.col("mine") & (F.col("n_best") > 1))).withColumn("kept", F.col("mine"))
    return rest.unionByName(tied).select("doc_id", _id(F.col("best"), sign).alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _id(rank, sign):
    return F.when(rank != (1 << 63) - 1, rank * sign)


def _salted_join(rows: DataFrame, groups: DataFrame, hot, how: str) -> DataFrame:
    """rows with groups on d. A hot group's row is repeated for each salt and its members are spread over them."""
    spread = groups.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    names = groups.filter(hot).select("d", F.lit(True).alias("is_hot"))  # fewer than 1 / HOT_SHARE rows
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id", "r"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    return rows.join(F.broadcast(names), "d", "left").withColumn("salt", salt).drop("is_hot").join(spread, ["d", "salt"], how).drop("salt")


def _verified(df, groups, sign, digest_bytes, id_col, text_col, hot_rows) -> DataFrame:
    """(same): for each row of a group, whether its bytes equal the keeper's."""
    spark = df.sparkSession
    key = F.conv(F.substring(F.hex("d"), 1, 15), 16, 10).cast("long")
    bits = spark.sparkContext.broadcast(bloom_bits(groups.select(key.alias("k"))))
    rank = F.coalesce(F.col(id_col).cast("long") * sign, F.lit((1 << 63) - 1))
    upper, lower = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()

    def hits(batches):
        import hashlib

        import pyarrow as pa

        table, filled = bytes.maketrans(upper, lower), bits.value
        for b in batches:
            texts = [t.translate(table) for t in utf8(b.column(2))]
            digests = [hashlib.sha256(t).digest()[:digest_bytes] for t in texts]
            keys = np.array([int(d.hex()[:15], 16) for d in digests], np.uint64)
            at = np.flatnonzero(bloom_hit(filled, keys))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([digests[i] for i in at], pa.binary()), pa.array([texts[i] for i in at], pa.binary())], ["doc_id", "r", "d", "t"])

    hit = df.select(F.col(id_col).cast("long").alias("doc_id"), rank.alias("r"), F.col(text_col).cast("string").alias("t")).mapInArrow(hits, "doc_id long, r long, d binary, t binary")
    hit = written(hit, "hits")
    hot = F.col("n") > hot_rows
    rows = _salted_join(hit, groups, hot, "inner")
    keepers = rows.filter("r = best").groupBy("d").agg(F.first("t").alias("keeper"), F.first("n").alias("n"))
    return _salted_join(hit, keepers, hot, "inner").select((F.col("t") == F.col("keeper")).alias("same"))


def _by_text(narrow, df, sign, id_col, text_col) -> DataFrame:
    """The same result grouped by the texts themselves."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t")).withColumn("r", F.coalesce(F.col("doc_id") * sign, F.lit((1 << 63) - 1)))
    groups = rows.groupBy("t").agg(F.min("r").alias("best"), F.count(F.lit(1)).alias("n"))
    out = rows.join(groups, "t")
    first = F.row_number().over(W.partitionBy("t", "r").orderBy("r")) == 1
    return out.withColumn("kept", (F.col("r") == F.col("best")) & first).select(
        "doc_id", _id(F.col("best"), sign).alias("keep_id"), F.col("n").alias("group_size"), "kept", F.sha2("t", 256).alias("text_sha256")
    )


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
