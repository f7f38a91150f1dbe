"""Comparison of nested tables, audits of recordings, robot descriptions, rows by place, chunks and sketches."""

import math

import pytest
from pyspark.sql import functions as F

from framegrain.functions import generators, geometry, urdf
from framegrain.operators import audits, compare, stats
from framegrain.sources import rowgroups

NAN, INF = float("nan"), float("inf")


def compared(a, b, keys=("k",), **options):
    return {(r.column, None if r.column and r.rows is not None else r.issue): r for r in compare.compare_tables(a, b, list(keys), **options).collect()}


def test_floats_and_nulls(spark):
    kind = "k int, x double, y array<array<float>>, z map<string,struct<p:double,q:string>>"
    a = [(1, 1.0, [[1.0, NAN], [INF]], {"a": (1.0, "u")}), (2, 0.0, None, None), (3, NAN, [[], None], {"b": (None, "v"), "a": (2.0, "w")}), (4, None, [[0.0]], {}), (None, 5.0, [[1.0]], {"a": (0.0, "")})]
    assert all(r.issue is None and r.rows in (5, None) for r in compared(spark.createDataFrame(a, kind), spark.createDataFrame(a[::-1], kind)).values())
    b = [(1, 1.0 + 1e-7, [[1.5, NAN], [-INF]], {"a": (1.5, "U")}), (2, 1e-7, [], None), (3, 2.0, [[], []], {"a": (2.0, "w"), "b": (None, "v")}), (4, 0.0, [[0.0, 1.0]], {"a": None}), (None, 5.0, [[2.0]], {"c": (0.0, "")})]
    got = compared(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind))
    x, y, z = (got[c, None] for c in "xyz")
    assert (x.different, x.leaves, x.issue, x.first_key) == (2, 2, "values differ", '{"k":3}') and x.max_abs == pytest.approx(1e-7) and x.max_rel == INF
    assert (y.different, y.leaves, y.issue, y.max_abs) == (5, 5, "shapes differ", 1.0)  # two leaves of 1, a null, a null inside, a longer row, and one leaf
    assert (z.different, z.leaves, z.issue, z.max_rel) == (3, 2, "shapes differ", 0.5)
    loose = compared(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), columns=["x"], atol=10.0)
    assert loose["x", None].different == 2 and len(loose) == 1


def test_issues_of_schemas_and_keys(spark):
    a = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (2, "b", 2.0)], "k int, s string, x double")
    b = spark.createDataFrame([(2.0, 2, 0), (3.0, 3, 0)], "x float, k int, w int")
    got = {(r.column, r.issue, r.rows) for r in compare.compare_tables(a, b, ["k"]).collect()}
    assert got == {("s", "missing", None), ("w", "added", None), ("x", "type float in place of double", None), ("x", "in the place of k", None), ("k", "in the place of x", None), (None, "rows missing", 1), (None, "rows added", 1), (None, "keys repeated in the expected table", 1)}
    none = compare.compare_tables(a.limit(0), a.limit(0), ["k"]).collect()
    assert {(r.column, r.issue, r.rows, r.max_abs) for r in none} == {("s", None, 0, None), ("x", None, 0, None)}
    deep = spark.createDataFrame([(1, [[[[1.0, 2.0]]]])], "k int, v array<array<array<array<double>>>>")
    moved = deep.withColumn("v", F.transform("v", lambda p: F.transform(p, lambda q: F.transform(q, lambda r: F.transform(r, lambda c: c + 0.25)))))
    r = compared(deep, moved)["v", None]
    assert (r.max_abs, r.max_rel, r.leaves, r.different) == (0.25, 0.25, 2, 1)


def test_audit_of_odd_recordings(spark):
    recordings = spark.createDataFrame([("a", 10, "pick"), ("b", None, "it's"), ("c", -1, ""), ("d", 10, "pick")], "recording string, length long, language string")
    color, depth = audits.COLORS + "/", audits.DEPTHS + "/"
    rows = [("a", color + "x", 3, 10, None), ("a", audits.CHANNELS + "/x", 1, 1, None), ("a", depth + "x", 3, 10, None), ("a", audits.CLOCK, 1, 10, None), ("a", "m_left_align/d", 2, 10, None), ("a", "m_right_align/d", 2, 9, None)]
    rows += [("b", color + "x", 3, 7, None), ("b", color + "y", 3, 8, None), ("b", "m_left_align/d", 2, 8, None), ("b", audits.CLOCK, 1, 7, "OSError:broken"), ("d", color + "x", 3, 9, None), ("d", audits.CLOCK, 1, 10, None)]
    datasets = spark.createDataFrame(rows, "recording string, path string, ndim int, length long, error string")
    clock = spark.createDataFrame([("a", i, [0, 1, 2, 3, NAN, 5, 6, 7, 8, 9][i] * 1.0) for i in range(10)] + [("d", i, float(min(i, 3))) for i in range(10)], "recording string, step long, value double")
    got = {}
    for r in audits.recording_issues(recordings, datasets, clock, expected_language="pick").collect():
        got.setdefault(r.recording, set()).add(r.issue)
    assert got["a"] == {"length_mismatch:m_right_align/d:expected=10:actual=9"}
    assert got["b"] == {
        "invalid_or_missing_trajectory_length", f"color_camera_not_declared:x", "color_camera_not_declared:y", f"rgb_length_mismatch:{color}y:expected=7:actual=8", f"inferred_length_mismatch:{color}y:expected=7:actual=8",
        "inferred_length_mismatch:m_left_align/d:expected=7:actual=8", "unreadable_camera_timestamp:OSError:broken", "missing_right_peer:m_right_align/d", 'language_instruction_mismatch:actual="it\'s"',
    }
    assert got["c"] == {"invalid_or_missing_trajectory_length", "missing_language_instruction"}
    assert got["d"] == {"color_camera_not_declared:x", f"length_mismatch:{color}x:expected=10:actual=9", "camera_timestamp_terminal_stall:steps=5"}
    assert audits.recording_issues(recordings.limit(0), datasets.limit(0), clock.limit(0)).count() == 0


def test_robot_descriptions(spark):
    xml = '<robot><joint name="j" type="{kind}"><parent link="a"/><child link="b"/><origin xyz="0 0 1" rpy="0 0 1.5707963267948966"/></joint><joint name="k" type="fixed"><parent link="b"/><child link="c"/><origin xyz="1 0 0"/></joint></robot>'
    chain = urdf.chain(xml.format(kind="revolute"), "a", "c", ["j"])
    end = spark.range(1).select(geometry.forward_kinematics(F.array(F.lit(math.pi / 2)), chain).alias("e")).first().e
    assert end.position == pytest.approx([0, 1, 1]) and end.rotation == pytest.approx([0, 0, 1, 1, 0, 0, 0, 1, 0], abs=1e-12)  # a quarter about z, then one about the default axis x
    for wrong, args in (("no chain", ("a", "z", ["j"])), ("not by", ("a", "c", ["j", "q"])), ("not by", ("b", "c", ["j"])), ("no chain", ("c", "a", []))):
        with pytest.raises(ValueError, match=wrong):
            urdf.chain(xml.format(kind="continuous"), *args)
    with pytest.raises(ValueError, match="planar"):
        urdf.chain(xml.format(kind="planar"), "a", "c", [])
    with pytest.raises(ValueError, match="a sign"):
        urdf.chain(xml.format(kind="revolute"), "a", "c", ["j"], [1.0, 2.0])


def test_rows_by_place(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(20_000).select("id", (F.col("id") * 2).alias("twice"), F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1).write.option("parquet.block.size", 1 << 14).parquet(path)
    groups = rowgroups.row_groups(rowgroups.files_of(spark, path))
    assert groups.count() > 3 and groups.agg(F.sum("rows")).first()[0] == 20_000
    name = groups.first().path
    asked = spark.createDataFrame([(i, name, r) for i, r in enumerate([0, 19_999, 5, 5, 12_345])], "i int, path string, row_index long")
    got = rowgroups.rows_at(asked, groups, "twice long").orderBy("i").collect()
    assert [(r.i, r.twice) for r in got] == [(0, 0), (1, 39_998), (2, 10), (3, 10), (4, 24_690)] and got[0].asDict().keys() == {"i", "path", "row_index", "twice"}
    for wrong in ((name, 20_000), (name, -1), ("file:///none", 0), (name, None)):
        with pytest.raises(Exception, match="no such row"):
            rowgroups.rows_at(spark.createDataFrame([(0, *wrong)], "i int, path string, row_index long"), groups, "twice long").collect()
    assert rowgroups.rows_at(asked.limit(0), groups, "twice long").count() == 0


def test_chunks_and_sketches(spark):
    generators.register(spark)
    rows = spark.sql("SELECT c.* FROM VALUES (array(1D, CAST(NULL AS DOUBLE), 3D)), (array()), (NULL) AS t(x), LATERAL chunks(CAST(x AS ARRAY<DOUBLE>), 2, 2) c").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 1.0, False), (0, 1, None, False), (2, 0, 3.0, False), (2, 1, 3.0, True)]
    df = spark.range(100_000).select((F.col("id") % 7).alias("shard"), F.col("id").cast("double").alias("v"))
    parts = stats.sketches(df.unionByName(spark.createDataFrame([(0, None), (1, NAN)], "shard long, v double")), "v", ["shard"])
    got = stats.merged_quantiles(parts.withColumn("g", F.lit(1)), ["g"], {"q": 0.3, "top": 1.0}).first()
    assert got.n == 100_000 and abs(got.q - 30_000) < 1_700 and got.top == 99_999
