"""Groups that are compared bucket by bucket, and rows that are repeated very often."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrain.llm import jaccard_join
from framegrain.llm.common import shingle_sets
from tests_llm_helpers import near_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def chain(n, step, length=60):
    """Texts that share all but `step` words with the one before: similar to their neighbours, to others less and less."""
    return [" ".join(f"w{k}" for k in range(i * step, i * step + length)) for i in range(n)]


def checked(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links, roots = near_groups(texts)
    least = {}
    for i, x in enumerate(roots):
        least[x] = min(least.get(x, i), i)
    out = jaccard_join.jaccard_join(df, **options).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in out) == [(i, least[roots[i]], links[i]) for i in range(len(texts))]
    assert sum(r.kept for r in out) == len(set(roots))


@pytest.mark.parametrize("tile", [1_500, 12])
def test_chains(spark, tile, monkeypatch):
    """Chains whose neighbours are at 0.67 and at 0.87, and copies of one text, whole and by buckets."""
    base = chain(1, 1, 200)[0].split()
    rng = np.random.default_rng(2)
    copies = [" ".join(w if j not in rng.integers(0, 200, k % 8) else f"x{k}" for j, w in enumerate(base)) for k in range(40)]
    texts = chain(150, 11) + [f"v{t}" for t in chain(120, 4)] + copies
    monkeypatch.setattr(jaccard_join, "WHOLE", 2)
    checked(spark, texts, tile=tile)


def test_a_chain_is_compared_along_its_buckets():
    """Texts in a chain of 400 meet few others in their buckets; the pairs found are those of all pairs."""
    sets = shingle_sets([t.encode() for t in chain(400, 5)])
    bands = np.array([jaccard_join.band_keys(jaccard_join.signature(s)) for s in sets])
    who, groups, band = [], [], []
    for b in range(jaccard_join.BANDS):
        for key in np.unique(bands[:, b]):
            mine = np.flatnonzero(bands[:, b] == key)
            if len(mine) > 1:
                who += mine.tolist()
                groups += [len(groups) + 1_000_000] * len(mine)
                band += [b] * len(mine)
    weights = np.arange(400)
    all_pairs = jaccard_join.linked(sets, weights, np.zeros(400, np.int64), None)
    by_bucket = jaccard_join.linked(sets, weights, np.array(groups), None, who=np.array(who), band=np.array(band))
    assert (all_pairs[0] == by_bucket[0]).all() and (all_pairs[1] == by_bucket[1]).all() and all_pairs[0].sum() == 2 * 399
    assert by_bucket[3] < 0.5 * all_pairs[3]


def test_a_row_repeated_very_often(spark):
    """Ten thousand rows alike in id and text beside one text at 0.84, and null texts: one row of the class is kept, and all of the others."""
    text = chain(1, 1)[0]
    rows = spark.range(20_000).select(F.when(F.col("id") < 10_000, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 10_000, F.lit(text)).alias("text"))
    beside = spark.createDataFrame([(2, text.replace("w30", "other"))], "doc_id long, text string")
    out = jaccard_join.jaccard_join(rows.unionByName(beside).repartition(8))
    got = {tuple(r[:3]): r.n for r in out.groupBy((F.col("doc_id") > 2).alias("empty"), "kept", "links").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(True, True, 0): 10_000, (False, False, 10_000): 10_000, (False, True, 10_000): 1}
    assert out.filter("kept AND doc_id = 1").count() == 1
