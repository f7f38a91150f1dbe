"""Snapshots, broken runs and vacuums; a journal that appends each run once."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from framegrain.sources import journal, versions


def frames(spark, episodes, tag, n=3):
    return spark.createDataFrame([(e, i, f"{tag}{i}") for e in episodes for i in range(n)], "episode_index long, frame_index long, v string")


def seen(df):
    return {(r.episode_index, r.v) for r in df.collect()}


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    with pytest.raises(FileNotFoundError):
        versions.snapshot(spark, root)
    assert versions.commit(frames(spark, [0, 1, None], "a"), root) == 1
    assert versions.commit(frames(spark, [2], "b", 1), root, expected=1) == 2
    first = versions.snapshot(spark, root)

    def broken():
        raise RuntimeError("stopped before the commit")

    with pytest.raises(RuntimeError, match="stopped"):
        versions.commit(frames(spark, [1, 2], "x"), root, fail=broken)
    a = lambda e: {(e, f"a{i}") for i in range(3)}
    assert seen(versions.snapshot(spark, root)) == a(0) | a(1) | a(None) | {(2, "b0")}
    assert versions.commit(frames(spark, [1, None], "c", 2), root) == 3
    now = a(0) | {(1, "c0"), (1, "c1"), (None, "c0"), (None, "c1"), (2, "b0")}
    assert seen(versions.snapshot(spark, root)) == now and seen(versions.snapshot(spark, root, 1)) == a(0) | a(1) | a(None)
    assert seen(first) == a(0) | a(1) | a(None) | {(2, "b0")}  # a reader that began before sees what it saw
    with pytest.raises(versions.ConcurrentCommit):
        versions.commit(frames(spark, [5], "z"), root, expected=2)
    assert [(r.version, r.episode, r.rows) for r in versions.history(spark, root).orderBy("version", "episode").collect()][:3] == [(1, None, 3), (1, 0, 3), (1, 1, 3)]
    assert versions.vacuum(spark, root) == []  # young runs may still commit, and every version has a live episode
    assert versions.commit(frames(spark, [2], "d", 1), root) == 4
    gone = versions.vacuum(spark, root, older_than=-5)
    assert len(gone) == 3  # the broken run, the one that came too late, and version 2
    assert len(os.listdir(tmp_path / "d" / "data")) == 3 and [e["version"] for e in versions.log(spark, root)] == [1, 3, 4]
    assert seen(versions.snapshot(spark, root)) == now - {(2, "b0")} | {(2, "d0")}


def test_commits_at_once_take_different_versions(spark, tmp_path):
    root = f"file://{tmp_path}/d"
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(versions.commit(frames(spark, [k], "a", 1), root))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4] and seen(versions.snapshot(spark, root)) == {(k, "a0") for k in range(4)}


def test_journal_appends_a_run_once(spark, tmp_path):
    path, kind = f"file://{tmp_path}/j", "id long, step int"
    rows = spark.range(1000).select("id", F.lit(0).alias("step")).repartition(6)
    broken = rows.withColumn("step", F.when(F.col("id") == 777, F.raise_error(F.lit("stopped")).cast("int")).otherwise(F.lit(0)))
    with pytest.raises(Exception, match="stopped"):
        journal.append_run(broken, path, "planned")
    assert journal.read_runs(spark, path, kind).count() == 0
    for _ in range(2):  # the job is run again, and once more after it is done
        journal.append_run(rows, path, "planned")
    journal.append_run(rows.filter("id < 10").withColumn("step", F.lit(1)), path, "done")
    journal.append_run(rows.limit(0), path, "none")
    got = journal.read_runs(spark, path, kind)
    assert got.count() == 1010 and got.filter("step = 0").select("id").distinct().count() == 1000
    assert [(r["run"], r["records"]) for r in journal.committed_runs(path)] == [("done", 10), ("none", 0), ("planned", 1000)]
    assert journal.read_runs(spark, path, "step int").agg(F.sum("step")).first()[0] == 10
    with pytest.raises(Exception, match="only appended"):
        rows.write.format("journal").option("run", "x").mode("overwrite").save(path)
    with pytest.raises(Exception, match="a run's name"):
        journal.append_run(rows, path, "a/b")
