"""Masks, columns by type, capped transitions, audits of documents and trees of schemas in small cases."""

import pytest
from pyspark.sql import functions as F

from framegrain.operators import episodes, governance, joins


def test_masks(spark):
    rows = spark.createDataFrame([("policy", True), ("policy", None), ("inverse_dynamics", True)], "k string, f boolean")
    shown = {m: rows.select("k", episodes.temporal_masks(F.col("k"), m).alias("m")).filter("k = 'inverse_dynamics'").first().m for m in episodes.SHOWN}
    assert [i for i, x in enumerate(shown["normal"].condition) if x] == [0, 1, 2, 3, 5, 6, 7] and [i for i, x in enumerate(shown["normal"].loss) if x] == [4]
    assert [i for i, x in enumerate(shown["current_only"].condition) if x] == [0, 1, 2, 3] and [i for i, x in enumerate(shown["future_only"].condition) if x] == [5, 6, 7]
    m = episodes.temporal_masks(F.col("k"))
    got = [r.m[4] for r in rows.select(episodes.without_failed_actions(m["loss"], F.col("k"), F.col("f")).alias("m")).collect()]
    assert got == [False, True, True]
    with pytest.raises(Exception, match="no mask for other"):
        spark.range(1).select(episodes.temporal_masks(F.lit("other"))).collect()
    with pytest.raises(ValueError):
        episodes.temporal_masks(F.col("k"), "none")


def test_columns_by_type(spark):
    rows = spark.createDataFrame([(0.5, [1.0, 2.0], 3)], "timestamp double, a array<double>, b int")
    one = {"a": {"dtype": "float32", "shape": (2,), "names": None}, "b": {"dtype": "int32", "shape": ()}, "c": {"dtype": "float32", "shape": (2, 2)}, "d": {"dtype": "float32", "shape": (2, 2)}}
    out, left = episodes.series_columns(rows, one)
    assert out.columns == ["timestamp", "a_0", "a_1", "b_0"] and tuple(out.first()) == (0.5, 1.0, 2.0, 3) and left == ["c", "d"]  # two in a row, both left out
    with pytest.raises(ValueError, match="2 channels"):
        episodes.series_columns(rows, {"a": {"dtype": "float32", "shape": (2,), "names": ["x"]}})


def test_capped_transitions(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("e"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("v"))
    some = joins.capped_transitions(rows, "e", ["i"], "v", "i", 30, 5)
    every = {r.i: r for r in joins.capped_transitions(rows, "e", ["i"], "v", "i", 1_000, 5).collect()}
    got = some.collect()
    assert len(got) == 30 and len(every) == 100 and all(r == every[r.i] for r in got) and sum(r.done for r in every.values()) == 7
    assert joins.capped_transitions(rows, "e", ["i"], "v", "i", 0, 5).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([("a", '{"x": {"y": 1}, "l": [1, 2]}'), ("b", '{"x": {}, "m": [1]}'), ("c", "nope"), ("d", None), ("e", '{"x": {"y": "1"}, "l": 3, "m": [1, 2]}')], "n string, d string")
    got = {}
    for r in governance.document_issues(docs, "n", "d", {"$.x.y": "1"}, {"$.l|$.m": 2}).collect():
        got.setdefault(r.n, set()).add(r.issue)
    assert got == {"b": {"x.y is missing, not 1", "l has not 2 values"}, "c": {"no document"}, "d": {"no document"}}
    good = '{"model": {"checkpoint_path": "m", "tokenizer_path": "t"}, "data": {"root": "r", "workers_per_rank": 0, "prefetch_factor": 1}, "training": {"batch_size_per_rank": 1, "gradient_accumulation_steps": 1}, "objectives": {"training_mode": "base_joint"}, "evaluation": {"sigma_values": [1.0]}}'
    configs = spark.createDataFrame([("good", good), ("none", "[]"), ("null", None), ("empty", "{}"), ("steps", good.replace('"batch', '"validation_every_steps": 5, "batch'))], "n string, d string")
    found = {}
    for r in governance.config_issues(configs, "n", "d").collect():
        found.setdefault(r.n, set()).add(r.issue)
    assert "good" not in found and found["none"] == found["null"] == {"no configuration"} and {"no data root", "unknown mode", "no sigmas within 0 and 1"} <= found["empty"]
    assert found["steps"] == {"step validation without batches", "step validation without targets"}


def test_tree_digests(spark):
    """The same subtree under different parents and in different files, one changed leaf, a file of one node, and parents without rows."""
    rows = [("f", "a/x", "d1"), ("f", "a/y", "d2"), ("f", "b/x", "d1"), ("f", "b/y", "d2"), ("g", "a/x", "d1"), ("g", "a/y", "d3"), ("h", "", "root"), ("k", "/a//x", "d1"), ("k", "a/y", "d2")]
    df = spark.createDataFrame(rows, "file string, path string, what string")
    got = {(r.file, r.path): (r.nodes, r.digest) for r in governance.tree_digests(df).collect()}
    assert len(got) == 7 + 4 + 1 + 4 and got["f", ""][0] == 7
    assert got["f", "a"] == got["f", "b"] == got["k", "a"] and got["f", "a"] != got["g", "a"] and got["f", "a/x"] == got["g", "a/x"] and got["f", ""] != got["k", ""]
    assert governance.tree_digests(df.limit(0)).count() == 0
    renamed = governance.tree_digests(spark.createDataFrame([("f", "a/x", "d1"), ("f", "a/z", "d2")], df.schema))
    assert {r.digest for r in renamed.filter("path = 'a'").collect()} != {got["f", "a"][1]}
