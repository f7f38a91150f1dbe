"""Anchors that very many places share are split by offset and merged like the others: the same rows as brute force."""

import collections
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from framegrain.llm import suffix_dedup

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def brute(texts, length):
    windows = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone.update(range(i, i + length))
        kept = bytes(c for i, c in enumerate(t) if i not in gone)
        out.append((len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return out


def texts(rng, length):
    """A passage shorter than a window in many surroundings, some of them in common to the left or to the right, and copies."""
    passage = "".join(rng.choice("abcd") for _ in range(length - 6))
    sides = ["".join(rng.choice("xyz") for _ in range(12)) for _ in range(6)]
    out = [rng.choice(sides)[: rng.randint(0, 12)] + passage[rng.randint(0, 2) :] + rng.choice(sides)[: rng.randint(0, 12)] for _ in range(70)]
    return out + out[:5] + [passage * 3, "", "short", passage[:-1]] + ["".join(rng.choice("ab") for _ in range(60)) for _ in range(5)]


@pytest.mark.parametrize(("hot", "length", "gram"), [(1, 24, 8), (2, 24, 8), (7, 24, 8), (2, 40, 8), (1, 9, 8), (1, 8, 8)])
def test_split_anchors(spark, hot, length, gram):
    rows = texts(random.Random(hot * 100 + length), length)
    want = brute([t.encode() for t in rows], length)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, length, gram, 200, hot).orderBy("doc_id").collect()
    assert [(r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want


def test_a_hot_context_is_one(spark):
    """A text with many copies, each with an end of its own: one context goes on, the rows are right."""
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(120))
    df = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.lit(""))).alias("text"))
    out = suffix_dedup.remove_repeats(df, 40, 8, 4_000, 50)
    assert out.count() == 3_000 and out.filter("n_spans <> 1 OR n_removed < 120").isEmpty()
    assert out.filter("doc_id % 2 = 1 AND n_removed <> n_bytes").isEmpty()
