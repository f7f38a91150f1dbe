"""The pipeline's stages against brute force on the smallest tables and on odd rows."""

import collections
from pathlib import Path

import pytest

import corpus_pipeline
from framegrain.llm import common
from framegrain.llm.common import written
from tests_llm_helpers import ODD, base_stats, lowered, near_groups

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_stages(spark, source):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if source == "documents" else spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), name)
        rows = docs.collect()
        if name == "quality_rules":
            passed = [r for r in before if not (lambda s: s[0] < 10 or 100 * s[4] > 20 * s[0])(base_stats(r.text))]
            assert len(rows) <= len(passed) and {r.doc_id for r in rows} <= {r.doc_id for r in passed}
        elif name == "exact_dedup":
            best = {}
            for r in before:
                k = lowered(r.text)
                best[k] = max(best.get(k, -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted((lowered(r.text), -1 if r.doc_id is None else r.doc_id) for r in rows) == sorted(best.items())
        elif name == "jaccard_join":
            _, roots = near_groups([r.text for r in before])
            assert len(rows) == len(set(roots)) and len({r.doc_id for r in rows}) == len(rows)
        elif name == "mixing":
            copies = collections.Counter(r.doc_id for r in rows)
            assert max(copies.values(), default=0) <= 2 and set(copies) <= {r.doc_id for r in before}
        else:
            assert all(r.round_trip for r in rows) and len(rows) == len(before)
        if name != "sentencepiece":
            assert docs.columns == columns


def test_empty_and_clashing(spark):
    rows = spark.createDataFrame(ODD[:3], "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS kept", "2 AS _row", "3 AS k1", "4 AS _K1", "5 AS copies")
    for docs in (rows.limit(0), rows):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()


def test_run(spark):
    began = len(common.WRITTEN)
    out = corpus_pipeline.run(spark, SF)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common.WRITTEN[began:]]
    assert left[0] == "stage-mixing" and all(Path(p.removeprefix("file://")).exists() for p in common.WRITTEN[began:]) and len(left) <= 3  # the last stage's input, and what it wrote itself
    assert out.columns == ["doc_id", "source", "n_ids", "ids", "round_trip"] and out.count() > 50
