"""Prefix sums in many ranges, digests as trees, reports by line."""

import hashlib

from pyspark.sql import functions as F

from framegrain.operators import datasets
from framegrain.operators.ranges import running
from framegrain.sources import tables


def test_many_ranges_with_a_hot_value(spark):
    """Half of the rows have one value in the first column, others are null: the second column cuts these ranges."""
    n = 3_000
    rows = [(5 if i % 2 else i % 40 or None, (i * 7_919) % n, i) for i in range(n)]
    df = spark.createDataFrame(rows, "a long, b long, i long")
    want, before = {}, 0
    for place, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        want[r[2]] = (place, before)
        before += r[2]
    got = running(df, ["a", "b"], {"v": F.col("i")}, rows=100)
    assert got.columns == ["a", "b", "i", "number", "before_v"] and {r.i: (r.number, r.before_v) for r in got.collect()} == want


def test_digest_tree(spark):
    def tree(lines, fan):
        level = [line.encode() for line in lines]
        while True:
            level = [hashlib.sha256(b"".join(level[k : k + fan])).hexdigest().encode() for k in range(0, len(level), fan)]
            if len(level) <= 1:
                return level[0].decode() if level else hashlib.sha256(b"").hexdigest()

    for n in (0, 1, 3, 4, 17, 64):
        rows = [(i, None if i % 5 == 2 else f"v{i}") for i in range(n)]
        df = spark.createDataFrame(rows[::-1], "k long, v string")
        got = datasets.digest(df, ["k"], ["k", "v"], fan=4).first()
        assert (got.rows, got.sha256) == (n, tree([f"{k}|{v or ''}\n" for k, v in rows], 4))


def test_reports_by_line(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|c", None), (1, None, 0.5)], "k int, s string, x double")
    assert [r.text for r in tables.markdown_lines(df, ["k"]).orderBy("line").collect()] == ["| k | s | x |", "| --- | --- | --- |", "| 1 |  | 0.5 |", "| 2 | b\\|c |  |"]
    tables.write_markdown(df, ["k"], f"file://{tmp_path}/r")
    names = sorted(p for p in (tmp_path / "r").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in names).splitlines()[2:] == ["| 1 |  | 0.5 |", "| 2 | b\\|c |  |"]
