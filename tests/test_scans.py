"""Ordered products against plain folds, and windows over long episodes."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrain.functions import geometry
from framegrain.operators import frames, joins, sampling, scans


def steps(n, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 0.02, (2, n))
    ca, sa, cb, sb = np.cos(a), np.sin(a), np.cos(b), np.sin(b)
    zero, one = np.zeros(n), np.ones(n)
    rz = np.stack([ca, -sa, zero, sa, ca, zero, zero, zero, one], axis=1).reshape(-1, 3, 3)
    rx = np.stack([one, zero, zero, zero, cb, -sb, zero, sb, cb], axis=1).reshape(-1, 3, 3)
    return np.hstack([(rz @ rx).reshape(-1, 9), rng.normal(0, 0.01, (n, 3))])


def folded(values, combine):
    out = [values[0]]
    for v in values[1:]:
        out.append(combine(out[-1][None], v[None])[0])
    return np.array(out)


@pytest.mark.parametrize("monoid", [scans.POSES, scans.CLAMPS])
def test_monoids_are_associative_and_clip(monoid):
    rng = np.random.default_rng(1)
    a, b, c = (steps(50, s) for s in range(3)) if monoid is scans.POSES else (np.hstack([rng.normal(0, 1, (50, 1)), np.sort(rng.normal(0, 1, (50, 2)))]) for _ in range(3))
    assert monoid.combine(monoid.combine(a, b), c) == pytest.approx(monoid.combine(a, monoid.combine(b, c)), abs=1e-12)
    held = scans.prefixes(np.stack([np.array([0.5, -0.9, 0.7, 0.7, -0.2]), np.zeros(5), np.ones(5)], axis=1), scans.CLAMPS)
    x, want = 0.3, []
    for d in (0.5, -0.9, 0.7, 0.7, -0.2):
        x = min(1.0, max(0.0, x + d))
        want.append(x)
    assert [min(h, max(lo, 0.3 + s)) for s, lo, h in held] == pytest.approx(want)


def test_scan_in_many_blocks(spark):
    """Episodes of 1, 4, 5, 64 and 300 frames in blocks of 4: up to five levels; a null episode counts as one."""
    rows, want = [], {}
    for e, n in ((0, 1), (1, 4), (2, 5), (None, 64), (4, 300)):
        values = steps(n, n)
        want[e] = folded(values, scans.POSES.combine)
        rows += [(e, i, v.tolist()) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "e long, i long, v array<double>").withColumn("_n", F.lit(1))
    got = {(r.e, r.i): r.p for r in scans.ordered_scan(df.repartition(5), "v", scans.POSES, "e", "i", "p", 4).collect()}
    assert len(got) == len(rows) and all(got[e, i] == pytest.approx(v, abs=1e-11) for e in want for i, v in enumerate(want[e]))
    assert scans.ordered_scan(df.limit(0), "v", scans.POSES, "e", "i", "p").count() == 0
    with pytest.raises(Exception, match="12 numbers"):
        scans.ordered_scan(df.withColumn("v", F.when(F.col("i") > 0, F.col("v"))), "v", scans.POSES, "e", "i", "p").collect()


def test_scan_of_a_million_frames(spark):
    n = 1_000_000
    a = F.sin(F.col("i") * 0.37) * 0.05
    value = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.01), F.lit(0.0), F.lit(0.001))
    df = spark.range(n).select(F.lit(7).alias("e"), F.col("id").alias("i")).withColumn("v", value).repartition(8)
    last = scans.ordered_scan(df, "v", scans.POSES, "e", "i", "p").filter(F.col("i") == n - 1).first().p
    turn = np.sin(np.arange(n) * 0.37) * 0.05
    heading = np.cumsum(turn)
    before = np.concatenate([[0.0], heading[:-1]])
    want = [np.cos(heading[-1]), np.sum(np.cos(before)) * 0.01, np.sum(np.sin(before)) * 0.01, n * 0.001]
    assert [last[0], *last[9:]] == pytest.approx(want, abs=1e-9 * n ** 0.5)


def test_integration_equals_the_fold_in_a_row(spark):
    """The same poses as `geometry.integrate`, which folds an array in one row."""
    rng = np.random.default_rng(5)
    rows = [(e, i, [*rng.uniform(-1, 1, 6).tolist(), float(rng.uniform(-1, 1))]) for e in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "e long, i long, a array<double>")
    scales = (0.05, 0.3, 0.6)
    first = spark.range(3).select(F.col("id").alias("e"), F.array(F.col("id") * 1.0, F.lit(0.2), F.lit(0.1)).alias("position"), geometry.euler_to_matrix(F.array(F.lit(0.4), F.lit(0.1), F.col("id") * 0.5)).alias("rotation"), F.lit(0.9).alias("gripper"))
    got = {(r.e, r.i): r for r in scans.integrated(df, "a", first, scales, "e", "i", block=8).collect()}
    listed = df.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("s")).join(first, "e")
    poses = geometry.integrate(F.col("position"), F.col("rotation"), F.transform("s", lambda x: geometry.decode_action(x["a"], *scales)))
    for r in listed.withColumn("p", poses).collect():
        grip = 0.9
        for i, p in enumerate(r.p[1:]):
            grip = min(1.0, max(0.0, grip + r.s[i].a[6] * scales[2]))
            assert got[r.e, i].position == pytest.approx(p.position, abs=1e-12) and got[r.e, i].rotation == pytest.approx(p.rotation, abs=1e-12)
            assert got[r.e, i].gripper == pytest.approx(grip)


def test_windows_over_a_long_episode(spark):
    """200,000 frames of one episode: seconds, as nothing is summed anew for every frame."""
    n = 200_000
    rows = spark.range(n).select(F.lit(0).alias("e"), F.col("id").alias("i"), F.lit(1.0).alias("r"), F.lit(True).alias("online"))
    began = time.time()
    reward, done = frames.success_tail(F.lit(True), 5, "e", ["i"])
    out = rows.select("i", reward.alias("reward"), done.alias("done"), frames.return_to_go("r", "e", ["i"]).alias("g"), frames.terminal_return(F.lit(1.0), 0.5, "e", ["i"]).alias("t"))
    assert tuple(out.agg(F.count_if("done"), F.max("g"), F.count_if(F.col("g") + F.col("i") == n), F.max("t")).first()) == (5, float(n), n, 1.0)
    assert sampling.frame_weights(rows, "online", "e", ["i"], 0.8, 10).filter("weight = 0").count() == 10
    asked = rows.select("e", (F.col("i") + 0.25).alias("at"), F.col("i").alias("k"))
    near = joins.nearest_asof(asked, rows.select("e", F.col("i").cast("double").alias("t"), F.col("i").alias("v")), "e", "at", "t", "v", 0.3)
    assert near.filter("v = k AND NOT is_pad").count() == n
    assert time.time() - began < 60
