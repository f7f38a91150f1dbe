"""One file an episode: local folders are written and listed by tasks, with the same tables as Spark's writer gives."""

import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framegrain.sources import tables

ODD = """CASE WHEN id % 9 < 8 THEN id % 9 END AS episode_index, id DIV 9 AS frame_index, id / 7D AS `a.b`, IF(id % 4 = 0, NULL, concat('é', id)) AS s, CAST(id AS DECIMAL(20, 3)) AS d,
date_add(DATE'0900-03-01', CAST(id AS INT)) AS day, timestamp_micros(id * 1000001 - 50000000000000000) AS t, CAST(timestamp_micros(id) AS TIMESTAMP_NTZ) AS u, CAST(id % 100 AS BYTE) AS y, CAST(concat('x', id) AS BINARY) AS bin,
transform(sequence(0, id % 3), x -> named_struct('k', x, 'v', CAST(x AS FLOAT))) AS l, map(concat('k', id % 5), IF(id % 2 = 0, id, NULL)) AS m"""


def files(root):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet"))


def test_tables_are_as_sparks_writer_makes_them(spark, tmp_path):
    rows = spark.sql(f"SELECT {ODD} FROM range(1000)").withMetadata("y", {"shape": [1], "dtype": "int8"})
    mine, theirs = f"file://{tmp_path}/a b=é/mine", f"{tmp_path}/theirs"  # without a scheme it is Spark's writer
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        tables.write_episodes(rows, mine, chunk=4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tables.write_episodes(rows, theirs, chunk=4)
    got, want = tables.read_episodes(spark, mine), tables.read_episodes(spark, theirs)
    assert got.schema.jsonValue() == want.schema.jsonValue() and got.schema["y"].metadata == {"shape": [1], "dtype": "int8"}
    text = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct("*")).alias("j")).collect())
    assert text(got) == text(want) and got.count() == 1_000
    found = files(tmp_path / "a b=é")
    assert [os.path.dirname(f).split("/mine/")[1] for f in found] == [os.path.dirname(f).split("/theirs/")[1] for f in files(theirs)] and len(found) == 9
    for f in found:
        frames = pq.ParquetFile(f).read(["frame_index"]).column(0).to_pylist()
        assert frames == sorted(frames) and len(frames) > 100
    # Hadoop's local file system, which starts processes for each file, leaves checksums beside what it writes.
    assert not [n for _, _, names in os.walk(tmp_path / "a b=é") for n in names if n.endswith(".crc")]
    listed = tables.episode_files(spark, mine)
    assert not listed.inputFiles()
    by_spark = spark.read.parquet(mine).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, by_spark.collect()))


def test_modes_failures_and_leftovers(spark, tmp_path):
    rows, root = spark.range(60).selectExpr("id % 6 AS episode_index", "id DIV 6 AS frame_index"), f"file://{tmp_path}/t"
    with pytest.raises(Exception, match="at 31"):
        tables.write_episodes(rows.withColumn("v", F.when(F.col("frame_index") == 5, F.raise_error(F.lit("at 31")))), root)
    assert not list(tmp_path.iterdir())
    tables.write_episodes(rows, root)
    assert [p.name for p in tmp_path.iterdir()] == ["t"] and len(files(tmp_path)) == 6
    with pytest.raises(Exception, match="(?i)already.exists"):
        tables.write_episodes(rows, root)
    tables.write_episodes(rows, root, mode="ignore")
    tables.write_episodes(rows, root, mode="append")
    (tmp_path / "t" / "_notes").mkdir()
    (tmp_path / "t" / "_notes" / "x.parquet").write_bytes(b"no table")
    assert tables.read_episodes(spark, root).count() == 120 and sorted(r.rows for r in tables.episode_files(spark, root).collect()) == [10] * 12
    tables.write_episodes(rows.limit(0), f"file:{tmp_path}/none")
    assert tables.episode_files(spark, f"file:{tmp_path}/none").count() == 0
    spans = rows.withColumn("wait", F.expr("INTERVAL '2' MONTH"))
    tables.write_episodes(spans, f"file:{tmp_path}/spans")
    assert tables.read_episodes(spark, f"file:{tmp_path}/spans").schema["wait"].dataType == spans.schema["wait"].dataType


def test_a_root_without_scheme_is_on_the_default_file_system(spark, tmp_path):
    rows, plain, theirs = spark.sql(f"SELECT {ODD} FROM range(300)"), f"{tmp_path}/plain é", f"{tmp_path}/theirs"
    tables.write_episodes(rows, plain, chunk=4)
    # Hadoop's local file system, which starts processes for each file, leaves checksums beside what it writes.
    assert len(files(plain)) == 9 and not [n for _, _, names in os.walk(plain) for n in names if n.endswith(".crc")]
    rows.withColumn("episode_chunk", F.floor(F.col("episode_index") / 4)).repartition("episode_index").write.partitionBy("episode_chunk", "episode_index").parquet(theirs)
    text = lambda df: sorted(r.j for r in df.select(F.to_json(F.struct("*")).alias("j")).collect())
    got, want = tables.read_episodes(spark, plain), spark.read.parquet(theirs)
    assert got.schema.jsonValue() == want.schema.jsonValue() and text(got) == text(want) and got.count() == 300
    listed = tables.episode_files(spark, plain)
    assert not listed.inputFiles()
    by_spark = spark.read.parquet(plain).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, by_spark.collect()))
    other = spark.newSession()
    other.conf.set("fs.viewfs.mounttable.frames.link./in", f"file://{tmp_path}")
    other.conf.set("fs.defaultFS", "viewfs://frames/")
    few = other.sql("SELECT id % 3 AS episode_index, id DIV 3 AS frame_index FROM range(12)")
    tables.write_episodes(few, "/in/viewed")
    assert len(files(tmp_path / "viewed")) == 3 and tables.read_episodes(other, "/in/viewed").count() == 12
    assert sorted(r.rows for r in tables.episode_files(other, "/in/viewed").collect()) == [4, 4, 4]
