"""Shared helpers: durable intermediate tables, bounded filters and whole-batch numpy text kernels."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrain.session import shared_dir

#: A word of every contract in this subpackage.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The same class as characters, for `translate`.
BLANKS = " \t\n\x0b\x0c\r"

SEED = 20_240_601
#: Tables that `written` made in this process and that are still there.
WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs one reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framegrain/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark, since: int, keep: int = 0) -> None:
    """Deletes the tables that `written` made after the first `since` ones, but for the last `keep`. Nothing may read them any more."""
    gone = WRITTEN[since : len(WRITTEN) - keep]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del WRITTEN[since : len(WRITTEN) - keep]


def crc_fold(id_col) -> F.Column:
    """crc32 of the id's text, modulo 5: 0 marks the held-out rows of the labelled operators."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bit_positions(keys: np.ndarray, log2_bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit key, shape (2, n)."""
    keys = mix64(keys)
    mask = np.uint64((1 << log2_bits) - 1)
    return np.stack([keys & mask, (keys >> np.uint64(32)) & mask])


def bloom_bits(keys: DataFrame, log2_bits: int = 23) -> np.ndarray:
    """A Bloom filter over the 64-bit column `k`, as bytes of fixed size (2^log2_bits / 8).

    The bits are OR-ed by Spark into words of 64 bits before the driver sees them, so the driver gets at
    most 2^log2_bits / 64 rows however many keys there are. A filter that fills up passes more rows to the
    exact join behind it and loses none.
    """
    def words(batches):
        import pyarrow as pa

        for b in batches:
            pos = bit_positions(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), log2_bits).ravel()
            word, inverse = np.unique(pos >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inverse, np.uint64(1) << (pos & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["w", "b"])

    rows = keys.select("k").mapInArrow(words, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(max(1, (1 << log2_bits) // 64), np.int64)
    for r in rows:
        out[r["w"]] = r["b"]
    return out.view(np.uint8)


def bloom_hit(bits: np.ndarray, keys: np.ndarray, log2_bits: int = 23) -> np.ndarray:
    pos = bit_positions(keys.astype(np.uint64), log2_bits)
    found = (bits[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1
    return found.all(axis=0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift-multiply), vectorised; x is uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE = np.uint64(0x8CB92BA72F3D8DD7)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def utf8(values) -> list[bytes]:
    """UTF-8 bytes of an Arrow string array, null as empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and each text's number of words."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    blank = _BLANK[buf]
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate(([True], blank[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    stops = np.flatnonzero(blank & np.concatenate(([False], inside[:-1])))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends, "left"))))
    length = stops - starts
    at = np.flatnonzero(inside)
    pos = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(length.max()) + 1, _BASE, np.uint64))
        terms = _BYTE[buf[at]] * power[pos]
        h = np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64)
    return mix64(h), counts


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams. A text of fewer words than `width` (but
    at least one) has the one shingle of all its words; a text without words has none."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = words * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(1, min(width, len(words))):
            rolled[: len(words) - k] = mix64(rolled[: len(words) - k] + words[k:] * np.uint64(2 * k + 1))
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            with np.errstate(over="ignore"):
                h = np.uint64(n)
                for w in words[at : at + n]:
                    h = mix64(np.array([h * np.uint64(31) + w], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
