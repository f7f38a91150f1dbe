"""Finding and finishing datasets: duplicates, refusals, gaps and broken transactions."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from framegrain.operators import datasets, episodes, joins, sampling
from framegrain.functions import geometry


def test_sources(spark):
    files = spark.createDataFrame([("/r/a/ep1/data/trajectory.hdf5", 5), ("/r/a/ep2/trajectory.hdf5", 6), ("/r/b/ep2/trajectory.hdf5", 7)], "path string, length long")
    name = F.get(F.split("path", "/"), F.lit(2))
    assert sorted(r.source_id for r in datasets.sources(files, name).collect()) == ["a/ep1", "a/ep2", "b/ep2"]
    gone = spark.createDataFrame([("a/ep2",), ("ep1",)], "id string")
    assert [r.source_id for r in datasets.sources(files, name, gone).collect()] == ["b/ep2"]
    with pytest.raises(Exception, match="two files for a source: x/ep2"):
        datasets.sources(files, F.lit("x")).collect()
    assert datasets.sources(files.limit(0), name).count() == 0


def test_paired_ids(spark):
    records = spark.createDataFrame([("d", 0, "c", None), ("d", 1, "c", ""), ("d", 2, "c", "/x/ep9/trajectory.hdf5")], "k string, ordinal long, collection string, source_path string")
    lists = spark.createDataFrame([("d", ["/x/ep1/data/t.hdf5", "/x/ep2/t.hdf5"])], "k string, sources array<string>")
    assert sorted(r.paired_id for r in datasets.paired_ids(records, "ordinal", lists, "k").collect()) == ["c/ep1", "c/ep2", "c/ep9"]
    with pytest.raises(Exception, match="no source"):
        datasets.paired_ids(records, "ordinal", lists.limit(0), "k").collect()
    with pytest.raises(Exception, match="two records"):
        datasets.paired_ids(records, "ordinal", lists.withColumn("sources", F.array(F.lit("/x/ep9/t"), F.lit("/x/ep8/t"))), "k").collect()


def test_inventory(spark):
    manifest = spark.createDataFrame([("/raw/a/1", "s", 10), ("/raw/a/2", "s", 10), ("/raw/b/1", "s", 10), ("/raw/c/1", "t", 10), ("/raw/d/1", "s", 10), ("/raw/e/1", None, 10), ("/raw/f/1", "s", 10)], "path string, schema_id string, file_bytes long")
    moves = spark.createDataFrame([("/raw/a", "/in/x"), ("/raw/b", "/in/x"), ("/raw/c", "/in/c"), ("/raw/d", "/out/d"), ("/raw/e", "/in/e")], "source string, destination string")
    catalog = spark.createDataFrame([("s", "arms")], "schema_id string, family string")
    listing = spark.createDataFrame([("/in/x/1", 10), ("/in/x/2", 9)], "path string, length long")
    good, bad = joins.with_coverage(manifest, moves, catalog, listing, "/in")
    assert {r.path: r.error for r in bad.collect()} == {
        "/raw/a/2": "file_size_mismatch", "/raw/b/1": "duplicate_destination_path", "/raw/c/1": "schema_missing_from_catalog", "/raw/d/1": "destination_outside_input", "/raw/e/1": "schema_missing_from_catalog", "/raw/f/1": "missing_covering_move",
    }
    assert {(r.path, r.new_path, r.actual_exists) for r in good.collect()} == {("/raw/a/1", "/in/x/1", True), ("/raw/a/2", "/in/x/2", True)}


def test_board_and_splits(spark):
    cells = spark.createDataFrame([(0, ["x"]), (1, ["B ", "a"]), (2, ["1", None]), (3, None), (4, [" ", ""])], "line int, row array<string>")
    assert [tuple(r) for r in datasets.located_columns(cells, "line", "row", {"a": "A", "b": "b"}).collect()] == [(2, None, "1")]
    paths = spark.createDataFrame([("/d/train/1",), ("/d/trainer/1",)], "p string")
    assert [r.s for r in paths.select(datasets.in_splits(F.col("p"), {"train": "/d/train"}, "none").alias("s")).collect()] == ["train", "none"]
    with pytest.raises(Exception, match="in no split"):
        paths.select(datasets.in_splits(F.col("p"), {"train": "/d/train"}).alias("s")).collect()


def test_versions(spark):
    names = spark.createDataFrame([(1, n) for n in ("v2.0", "2.10", "v2.9", "v3.0", "2.9.5", "main", None)], "k int, name string")
    assert datasets.compatible_version(names, ["k"], "name", "v2.9.5").first().version == "2.9.5"
    assert datasets.compatible_version(names, ["k"], "name", "2.99").first().version == "2.10"
    assert datasets.compatible_version(names, ["k"], "name", "1.0").count() == 0


def test_resume(spark):
    done = lambda *e, f="a": spark.createDataFrame([(i, f) for i in e], "e long, f string")
    point = lambda d: tuple(datasets.resume_point(d, "e", "f", "a").first())
    assert point(done(0, 1, 2)) == (3, None) and point(done(0, 1, 3)) == (2, "gap") and point(done(0, 0)) == (1, "episode twice")
    assert point(done(1, 2)) == (0, "gap") and point(done(0, f="b")) == (1, "fingerprint changed") and point(done(0).limit(0)) == (0, None)


def test_checked_rows_and_conversions(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, math.inf])], "i int, v array<double>")
    assert datasets.checked_rows(rows, F.col("i") == 1, {"v": 2}).count() == 1
    for i in (2, 3):
        with pytest.raises(Exception, match="v (has wrong size|not finite)"):
            datasets.checked_rows(rows, F.col("i") == i, {"v": 2}).collect()
    assert [r.s for r in rows.filter("i = 2").select(geometry.as_scalar(F.col("v")).alias("s")).collect()] == [1.0]
    with pytest.raises(Exception, match="more than one"):
        rows.select(geometry.as_scalar(F.col("v")).alias("s")).collect()
    with pytest.raises(ValueError):
        geometry.center(F.col("v"), 2, 2, 3)
    with pytest.raises(Exception, match="another shape"):
        rows.select(geometry.center(F.col("v"), 2, 2, 1).alias("c")).collect()


def test_proprio_must_be_finite(spark):
    rows = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 2.0], 0.5), (1, 1, [math.nan, 0.0, 0.0], [0.0, 0.0, 0.0, -2.0], 0.5)], "e int, i int, p array<double>, q array<double>, g double")
    args = ("p", "q", "g", "e", ["i"], [-1.0] * 7 + [0.0], [1.0] * 8)
    assert episodes.proprio(rows.filter("i = 0"), *args).first().proprio == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    with pytest.raises(Exception, match="not finite"):
        episodes.proprio(rows, *args).collect()


def test_shuffled_rank(spark):
    """The same places as one window over each group."""
    df = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") % 2_900).alias("k"))
    one = F.row_number().over(Window.partitionBy("g").orderBy(sampling.shuffled(5, "k"), "k"))
    want = sorted(map(tuple, df.withColumn("r", one).select("g", "k", "r").collect()))
    assert sorted(map(tuple, sampling.shuffled_rank(df, "g", "k", 5, "r").select("g", "k", "r").collect())) == want


def test_markdown_and_patterns_have_bounds(spark, monkeypatch):
    from framegrain.sources import tables

    monkeypatch.setattr(tables, "MOST_REPORT_ROWS", 3)
    monkeypatch.setattr(joins, "MOST_PATTERNS", 3)
    assert tables.markdown(spark.range(3)).count("\n") == 5
    with pytest.raises(ValueError):
        tables.markdown(spark.range(4))
    with pytest.raises(ValueError):
        joins.single_pattern_join(spark.createDataFrame([("a",)], "t string"), spark.range(4).select(F.col("id").cast("string").alias("p"), F.lit(1).alias("v")), "t", "p", "v", "none")
