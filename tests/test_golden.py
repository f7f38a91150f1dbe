"""Small cases with known results, nulls, ties and empty inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrain.functions import geometry, text
from framegrain.operators import frames, governance, joins, metrics, sampling, sets, stats
from framegrain.operators.ranges import running
from framegrain.plans.steps import Pipeline, REGISTRY
from framegrain.sources import tables
from framegrain.streaming import operators as streams


@pytest.fixture(scope="module")
def six(spark):
    return spark.createDataFrame([(i, e) for i, e in enumerate([0, 0, 1, 2, 2, 2])], "i long, e long")


def ids(df, column="i"):
    return sorted(r[column] for r in df.collect())


def test_drop_edges(six):
    assert ids(frames.drop_edge_frames(six, "e", ["i"], first=1)) == [1, 4, 5]
    assert ids(frames.drop_edge_frames(six, "e", ["i"], last=1)) == [0, 3, 4]
    assert ids(frames.drop_edge_frames(six, "e", ["i"], episodes=[0, 2])) == [0, 1, 3, 4, 5]
    assert ids(frames.drop_edge_frames(six.limit(0), "e", ["i"], first=1)) == []


def test_bounds_and_chunks(spark, six):
    assert [tuple(r) for r in frames.episode_bounds(six, "e").orderBy("e").collect()] == [(0, 2, 0, 2, 0), (1, 1, 2, 3, 1), (2, 3, 3, 6, 2)]
    rows = {r.i: (r.c, r.p, r.f) for r in six.select("i", frames.forward_chunk("i", 3, "e", ["i"]).alias("c"), frames.chunk_padding(3, "e", ["i"]).alias("p"), frames.future_value("i", 2, "e", ["i"]).alias("f")).collect()}
    assert rows[0] == ([0, 1, 1], 1, 1) and rows[2] == ([2, 2, 2], 2, 2) and rows[3] == ([3, 4, 5], 0, 5)


def test_offsets_of_seconds():
    assert frames.seconds_to_offsets([-0.2, 0, 0.1], 10, 1e-4) == [-2, 0, 1]
    with pytest.raises(ValueError):
        frames.seconds_to_offsets([0.03], 10, 1e-4)


def test_nearest_asof(spark):
    known = spark.createDataFrame([(0, k / 10, k) for k in range(5)], "e long, t double, v long")
    def at(offsets, tolerance=0.04):
        asked = spark.createDataFrame([(0, 0.2 + o, k) for k, o in enumerate(offsets)], "e long, at double, k int")
        out = joins.nearest_asof(asked, known, "e", "at", "t", "v", tolerance).orderBy("k").collect()
        return [r.v for r in out], [r.is_pad for r in out]
    assert at([-0.2, 0, 0.139]) == ([0, 2, 3], [False, False, False])
    assert at([-0.3, -0.24, 0, 0.26, 0.3]) == ([0, 0, 2, 4, 4], [True, False, False, True, True])
    assert at([0.141])[1] == [True]


def test_timestamps(spark):
    def gaps(last):
        rows = spark.createDataFrame([(0, i, i / 10 if i < 3 else 0.3 + last) for i in range(4)], "e int, i int, t double")
        return frames.timestamp_gaps(rows, "t", 10, 1e-4, "e", ["i"]).count()
    assert gaps(1.1e-4) == 1 and gaps(0.9e-4) == 0
    stall = lambda ts: frames.trailing_stall(spark.createDataFrame([(0, i, float(t)) for i, t in enumerate(ts)], "e int, i int, t double"), "t", "e", ["i"]).first().stall
    assert stall([0, 1, 2]) == 0 and stall([0, 1, 1, 1]) == 2 and stall([5]) == 0 and stall([3, 2, 1]) == 2


def test_returns(spark):
    rows = spark.createDataFrame([(0, i, float(r)) for i, r in enumerate([0, 0, 1])], "e int, i int, r double")
    out = frames.discounted_returns(rows, "r", 0.5, "e", ["i"], into="d").select("i", "d", frames.return_to_go("r", "e", ["i"]).alias("g")).orderBy("i").collect()
    assert [r.d for r in out] == [0.25, 0.5, 1.0] and [r.g for r in out] == [1.0, 1.0, 1.0]
    reward, done = frames.success_tail(F.lit(True), 5, "e", ["i"])
    long = spark.range(12).select(F.lit(0).alias("e"), F.col("id").alias("i")).select("i", reward.alias("r"), done.alias("d"))
    assert [r.d for r in long.orderBy("i").collect()] == [False] * 7 + [True] * 5


def test_quaternion_signs(spark):
    q = [[0.0, 0.0, a, b] for a, b in ((0.0, 1.0), (0.1, 1.0), (-0.2, -1.0), (-0.3, -1.0), (0.4, 1.0))]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(q)], "e int, i int, q array<double>")
    out = [r.q for r in frames.continuous_quaternions(rows, "q", "e", ["i"]).orderBy("i").collect()]
    assert all(sum(a * b for a, b in zip(x, y)) > 0 for x, y in zip(out[:-1], out[1:])) and all(abs(sum(a * a for a in x) - 1) < 1e-12 for x in out)


def test_metrics(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (2.0, 2.0)], "p double, t double").agg(*metrics.regression_errors(F.col("p"), F.col("t"))).first()
    assert rows.mae == pytest.approx(1 / 3) and rows.mse == pytest.approx(1 / 3)
    scored = spark.createDataFrame([(1, 0.1, 0), (2, 0.4, 0), (3, 0.35, 1), (4, 0.8, 1)], "i int, s double, y int")
    assert metrics.auroc(scored, "s", "y").first().auroc == 0.75
    assert metrics.average_precision(scored, "s", "y", "i").first().average_precision == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.auroc(scored.filter("y = 1"), "s", "y").first().auroc is None
    assert metrics.auroc(scored.withColumn("s", F.lit(0.5)), "s", "y").first().auroc == 0.5
    assert metrics.spearman(scored.limit(1), "s", "y").first().spearman is None
    assert metrics.calibration_error(spark.createDataFrame([(0.95, 1), (0.95, 1), (1.0, 0)], "p double, y int"), "p", "y").first().ece == pytest.approx(abs((0.95 * 2 + 1) / 3 - 2 / 3))
    two = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 4.0)], "e string, v double").withColumn("k", F.lit(1))
    assert tuple(metrics.episode_means(two, "e", "v", ["k"]).first())[1:] == (2, 3.0)
    row = metrics.bootstrap_interval(two, "e", "v", ["k"], resamples=200).first()
    assert row.episodes == 2 and row["mean"] == 3.0 and row.low <= 3.0 <= row.high


def test_rollout_keeps_one_step_more(spark):
    rows = spark.createDataFrame([(0, s, 1.0, s == 2, False) for s in range(6)], "r int, s int, v double, d boolean, ok boolean")
    assert metrics.rollouts(rows, "r", "s", "v", "d", "ok").first().sum_reward == 4.0


def test_statistics(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(40, 3))
    df = spark.createDataFrame([(i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "k int, v array<double>")
    whole = stats.merged_stats(stats.channel_stats(df, "v", ["k"]), []).orderBy("channel").collect()
    assert np.allclose([r["mean"] for r in whole], x.mean(0)) and np.allclose([r["std"] for r in whole], x.std(0))
    one = df.limit(1).withColumn("n", stats.scale_minmax("v", [-1.0] * 3, [3.0] * 3)).withColumn("b", stats.unscale_minmax("n", [-1.0] * 3, [3.0] * 3)).first()
    assert np.allclose(one.v, one.b) and np.allclose(one.n, 2 * (np.array(one.v) + 1) / 4 - 1)
    assert stats.constant_channels(stats.channel_stats(spark.createDataFrame([([1.0, 2.0],), ([1.0, 3.0],)], "v array<double>"), "v", [])).count() == 1


def test_split_sizes(spark):
    def greedy(n, ratios):
        sizes = [0] * len(ratios)
        for k in [k for k, r in enumerate(ratios) if r > 0][:n]:
            sizes[k] = 1
        for _ in range(n - sum(sizes)):
            sizes[max(range(len(ratios)), key=lambda j: (round(ratios[j] * n - sizes[j], 9), -j))] += 1
        return sizes

    counts = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 7, 10, 20, 101, 999)], "n long")
    for ratios in ((0.8, 0.1, 0.1), (1.0, 0.0), (0.98, 0.01, 0.01), (0.25, 0.75), (0.5, 0.0, 0.5)):
        got = counts.select("n", sampling.split_sizes(F.col("n"), ratios).alias("s")).collect()
        assert {r.n: r.s for r in got} == {r.n: greedy(r.n, ratios) for r in got}
    assert counts.limit(1).select(sampling.split_sizes(F.lit(10**12), (0.8, 0.1, 0.1)).alias("s")).first().s == [8 * 10**11, 10**11, 10**11]
    with pytest.raises(ValueError):
        sampling.split_sizes(F.lit(1), (0.5, 0.1))


def test_coprime_from(spark):
    pairs = [(a, n) for a in (1, 2, 14, 26, 114) for n in (1, 2, 7, 30, 210, 2_310, 97 * 89, 2**40)]
    rows = spark.createDataFrame(pairs, "a long, n long").select("a", "n", sampling.coprime_from(F.col("a"), F.col("n")).alias("c")).collect()
    assert all(r.c == next(x for x in range(r.a, r.a + 400) if math.gcd(x, r.n) == 1) for r in rows)


def test_running(spark):
    """Places and prefix sums over numbers and strings, with ties, nulls and few rows."""
    for n in (0, 1, 3, 700):
        rows = [(i * 37 % 101 if i % 9 else None, f"k{i * 53 % 211:03d}", i) for i in range(n)]
        df = spark.createDataFrame(rows, "a long, b string, i long")
        for order in (["a", "i"], ["b", "i"]):
            want, before = {}, 0
            for place, r in enumerate(sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0) if order[0] == "a" else (True, r[1]), r[2]))):
                want[r[2]] = (place, before)
                before += r[2]
            assert {r.i: (r.number, r.before_v) for r in running(df, order, {"v": F.col("i")}).collect()} == want


def test_discounted_returns_of_long_episodes(spark):
    rng = np.random.default_rng(4)
    reward = rng.normal(0, 1, 3_000)
    df = spark.createDataFrame([("a", i, float(r)) for i, r in enumerate(reward)] + [("b", 0, 1.5)], "e string, i long, r double")
    for gamma in (0.5, 0.97, 0.999, 1.0):
        want, total = {("b", 0): 1.5}, 0.0
        for i in range(len(reward) - 1, -1, -1):
            total = total * gamma + reward[i]
            want[("a", i)] = total
        for block in (64, 4_096):
            for index in (None, "i"):
                got = frames.discounted_returns(df, "r", gamma, "e", ["i"], index, "d", block).collect()
                assert {(r.e, r.i): pytest.approx(r.d, rel=1e-9, abs=1e-9) for r in got} == want


def test_sampler_weights(spark):
    rows = spark.createDataFrame([(i, False, 0) for i in range(4)] + [(i, True, 1 + i // 2) for i in range(4, 12)], "i int, online boolean, e int")
    w = lambda drop: [r.weight for r in sampling.frame_weights(rows, "online", "e", ["i"], 0.8, drop).orderBy("i").collect()]
    assert w(0) == pytest.approx([0.05] * 4 + [0.1] * 8)
    assert w(1) == pytest.approx([0.05] * 4 + [0.2, 0.0] * 4)


def test_samplers_repeat_and_balance(spark):
    rows = spark.range(100).select(F.col("id").alias("k"), (F.col("id") < 10).cast("int").alias("y"))
    a = sampling.label_balanced(rows, "y", "k", 50, 0.8, 3)
    assert a.filter("y = 1").count() == 40 and a.filter("y = 0").count() == 10
    assert ids(sampling.capped_subset(rows, "k", 7, 1), "k") == ids(sampling.capped_subset(rows.repartition(5), "k", 7, 1), "k")
    split = sampling.stratified_split(rows.withColumn("t", F.lit("a")), "t", "k", {"train": 0.5, "test": 0.5}, 1)
    assert {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 50, "test": 50}


def test_governance(spark):
    f = spark.createDataFrame([("p", ["x"]), ("q", ["x", "y"]), ("r", []), ("s", ["other"])], "k string, i array<string>")
    out = {r.k: r.s for r in f.select("k", governance.severity(F.col("i"), {"x": "warning", "y": "unreadable"}).alias("s")).collect()}
    assert out == {"p": "warning", "q": "unreadable", "r": "passed", "s": "review"}
    files = spark.createDataFrame([("a", 1, "s", "g", True), ("a", 2, "s", "g", True), ("b", 1, "s", "g", True), ("b", 2, "t", "g", True), ("c", 1, "s", "g", False)], "b string, e int, s string, q string, m boolean")
    plan, conflicts = governance.move_plan(files, "b", "e", "s", "q", "m")
    assert sorted((r.unit, r.b, r.e) for r in plan.collect()) == [("batch", "a", None), ("episode", "b", "1"), ("episode", "b", "2")] or sorted((r.unit, r.b) for r in plan.collect()) == [("batch", "a"), ("episode", "b"), ("episode", "b")]
    assert [r.b for r in conflicts.collect()] == ["c"]
    rules = governance.vector_contract("v", 2)
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, math.nan],), (None,)], "v array<double>").select(governance.issues(rules).alias("i"))
    assert [len(r.i) for r in v.collect()] == [0, 1, 1, 1]


def test_interval_labels_override(spark):
    rows = spark.range(6).select(F.lit(0).alias("e"), F.col("id").alias("p"))
    labels = spark.createDataFrame([(0, 0, 4, 0, "a"), (0, 2, 3, 1, "b"), (0, 5, 5, 2, "c")], "e int, start_pos long, end_pos long, ordinal int, label string")
    out = joins.interval_labels(rows, labels, "e", "p", bucket=2).orderBy("p").collect()
    assert [r.label for r in out] == ["a", "a", "b", "b", "a", "c"] and [r.is_end for r in out] == [False, False, False, True, True, True]
    assert out[3].progress == 1.0 and out[5].progress == 0.0


def test_prefix_pattern_and_request(spark):
    paths = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    names = spark.createDataFrame([("a", 1), ("a/b", 2)], "prefix string, v int")
    assert {r.path: r.v for r in joins.longest_prefix_join(paths, names, "path", "prefix", "v").collect()} == {"a/b/c": 2, "a/x": 1, "z": None}
    p = spark.createDataFrame([("AB", "one"), ("b", "two")], "pat string, v string")
    t = spark.createDataFrame([("xab",), ("b",), ("q",), (None,)], "t string")
    assert {r.t: r.v for r in joins.single_pattern_join(t, p, "t", "pat", "v", "none").collect()}["b"] == "two"
    with pytest.raises(Exception, match="not found"):
        joins.in_request_order(spark.range(3), [1, 9], "id").collect()


def test_geometry(spark):
    h = math.sqrt(0.5)
    row = spark.range(1).select(
        geometry.quaternion_to_matrix(F.array(F.lit(0.0), F.lit(0.0), F.lit(h), F.lit(h))).alias("m"),
        geometry.matrix_to_euler(geometry.quaternion_to_matrix(F.array(F.lit(0.0), F.lit(0.0), F.lit(h), F.lit(h)))).alias("e"),
        geometry.tiled(F.array(F.lit(1), F.lit(2)), 5).alias("t"),
    ).first()
    assert row.m == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1], abs=1e-12) and row.e == pytest.approx([0, 0, math.pi / 2]) and row.t == [1, 2, 1, 2, 1]
    with pytest.raises(Exception, match="direction"):
        spark.range(1).select(geometry.unit(F.array(F.lit(0.0), F.lit(0.0)))).collect()
    # twenty frames of 1 cm along local x and 0.03 rad about z
    step = F.struct(F.array(F.lit(0.01), F.lit(0.0), F.lit(0.0)).alias("translation"), geometry.euler_to_matrix(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.03))).alias("rotation"))
    eye = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)])
    poses = spark.range(1).select(geometry.integrate(F.array(*[F.lit(0.0)] * 3), eye, F.array_repeat(step, 19)).alias("p")).first().p
    assert len(poses) == 20 and poses[-1].position[0] == pytest.approx(sum(0.01 * math.cos(0.03 * k) for k in range(19)))
    action = spark.range(1).select(geometry.encode_action(step, F.lit(0.3), 0.02, 0.06, 1.0).alias("a")).first().a
    assert action == pytest.approx([0.5, 0, 0, 0, 0, 0.5, 0.3])
    arm = [{"kind": "revolute", "axis": (0, 0, 1)}, {"kind": "fixed", "xyz": (1, 0, 0)}, {"kind": "prismatic", "axis": (1, 0, 0)}]
    end = spark.range(1).select(geometry.forward_kinematics(F.array(F.lit(math.pi / 2), F.lit(0.5)), arm).alias("f")).first().f
    assert end.position == pytest.approx([0, 1.5, 0], abs=1e-12)


def test_text(spark):
    row = spark.createDataFrame([("  a//b c.. ", "robot_x_20240230_20240131", '=HYPERLINK("https://a/""b""","lab")', "a=1,b=2", 1536)], "a string, n string, h string, p string, s long").select(
        text.slug(F.col("a")).alias("slug"), text.last_date(F.col("n")).cast("string").alias("d"), text.hyperlink(F.col("h")).alias("u"), text.hyperlink(F.col("h"), True).alias("l"),
        text.pairs(F.col("p")).alias("m"), text.byte_size(F.col("s")).alias("b"), text.without_affixes(F.col("n"), ["robot"]).alias("w"), text.dated_from(F.col("a"), "20240101").alias("x"),
    ).first()
    assert tuple(row) == ("a_b_c", "2024-01-31", 'https://a/"b"', "lab", {"a": "1", "b": "2"}, "1.50 KiB", "x_20240230", False)
    with pytest.raises(Exception, match="k=v"):
        spark.createDataFrame([("a",)], "p string").select(text.pairs(F.col("p"))).collect()
    assert text.fingerprint({"b": 1, "a": [1, 2]}) == text.fingerprint({"a": [1, 2], "b": 1})


def test_sets(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "y int, z int")
    assert sets.union_common([a, b]).columns == ["dataset_index", "y"] and sets.union_all([a, b]).columns == ["x", "y", "z"]
    assert sets.missing_columns(a, ["x", "q"]) == ["q"]


def test_stream_merge_and_filter(spark, tmp_path):
    chunks = spark.createDataFrame([(0, 0, 0, [1.0, 1.0, 1.0], -1), (0, 1, 1, [2.0, 2.0, 2.0], 1)], "k int, o long, first long, actions array<double>, executed long")
    chunks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    got = []
    q = streams.merge_chunks(stream, "k", "o", "first", "actions", "executed").writeStream.foreachBatch(lambda b, n: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.step, round(r.action, 6)) for r in got if r.o == 1) == [(2, 1.7), (3, 2.0)]
    rows = spark.createDataFrame([(0, 0, [0.0], False), (0, 1, [0.05], False), (0, 2, [1.0], False), (0, 3, [1.0], True)], "k int, s long, v array<double>, m boolean")
    rows.write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in2"))
    got2 = []
    q = streams.similarity_filter(stream, "k", "s", "v", "m", 0.5).writeStream.foreachBatch(lambda b, n: got2.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.s for r in got2) == [0, 2, 3]


def test_similarity_filter_forgets_no_step(spark, tmp_path):
    # even steps, then the odd ones between them, then all again: two keys, many more than 1,000 steps
    parts = [[2 * i for i in range(1500)], [2 * i + 1 for i in range(1000)], [*range(3000)]]
    schema = "k int, s long, v array<double>, m boolean"
    got: list = []
    for n, steps in enumerate(parts):
        rows = spark.createDataFrame([(k, s, [float(10 * s + n)], False) for k in (0, 1) for s in steps], schema)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out: list = []
        streams.similarity_filter(stream, "k", "s", "v", "m", 0.5).writeStream.foreachBatch(lambda b, i, out=out: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got.append(sorted((r.k, r.s) for r in out))
    assert got == [[(k, s) for k in (0, 1) for s in steps] for steps in (parts[0], sorted(parts[1]), [2 * i + 1 for i in range(1000, 1500)])]


def test_batch_merge_by_key(spark):
    old = spark.createDataFrame([(1, 4, 1.0), (1, 5, 1.0), (2, 5, 9.0)], "k int, step long, action double")
    new = spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.0), (2, 4, 3.0), (2, 5, 3.0), (3, 0, 7.0)], "k int, step long, action double")
    executed = spark.createDataFrame([(1, 3), (1, 5), (2, 3)], "k int, executed long")
    out = streams.merged_batch(old, new, executed, ["k"]).collect()
    assert sorted((r.k, r.step, round(r.action, 6)) for r in out) == [(1, 6, 2.0), (2, 4, 3.0), (2, 5, 4.8), (3, 0, 7.0)]


def test_messages(spark):
    parts = spark.createDataFrame([(1, 0, "BEGIN", "ab"), (1, 1, "END", "c"), (2, 0, "BEGIN", "x"), (3, 0, "END", "")], "m int, o int, k string, p string")
    assert {r.m: (r.p, r.complete) for r in streams.reassembled(parts, "m", "o", "k", "p").collect()} == {1: ("abc", True), 2: ("x", False), 3: ("", True)}
    with pytest.raises(Exception, match="unknown part"):
        streams.reassembled(parts.withColumn("k", F.lit("?")), "m", "o", "k", "p").collect()


def test_steps(spark):
    df = spark.createDataFrame([([0.0, 5.0], [9.0, 9.0], True, "t")], "action array<double>, action_intervention array<double>, is_intervention boolean, s string")
    p = Pipeline([REGISTRY["override_action"](), REGISTRY["normalize"](column="action", min=[-9.0, -9.0], max=[9.0, 9.0]), REGISTRY["rename"](columns={"s": "task", "none": "x"})])
    seen = []
    p.after.append(lambda i, d: seen.append(i))
    assert p(df).first().action == [1.0, 1.0] and seen == [0, 1, 2]
    again = Pipeline.loads(p.dumps(), {"rename": {"columns": {"s": "name"}}})
    assert again(df).columns[-1] == "name" and len(again[1:]) == 2 and "task" in p.contract(df.schema, spark).names
    with pytest.raises(KeyError):
        Pipeline.loads(p.dumps(), {"nope": {}})
    wide = REGISTRY["expand_action"](column="action", enabled=[0, 3], size=4)(df).first().action
    assert wide == [0.0, 0.0, 0.0, 5.0] and REGISTRY["numeric_only"](keep=["s"])(df).columns == df.columns


def test_tables(spark, tmp_path):
    schema = tables.schema_of({"action": {"dtype": "float32", "shape": (2,)}, "next.reward": {"dtype": "float32", "shape": (1,)}, "cam": {"dtype": "video", "shape": (3, 4)}})
    assert schema.names[:2] == ["action", "next.reward"] and "cam" not in schema.names
    with pytest.raises(ValueError):
        tables.schema_of({"a/b": {"dtype": "int64", "shape": (1,)}})
    rows = spark.createDataFrame([(e, i, float(i)) for e in (0, 1, 1001) for i in range(3)], "episode_index long, frame_index long, v double")
    tables.write_episodes(rows, str(tmp_path / "d"))
    assert tables.read_episodes(spark, str(tmp_path / "d"), [1001]).count() == 3
    assert tables.episode_files(spark, str(tmp_path / "d")).count() == 3
    (tmp_path / "m.jsonl").write_text('{"mode": "train", "global_step": 3, "loss": 0.5, "ok": true, "name": "x"}\n\n')
    assert [tuple(r) for r in tables.read_metrics(spark, str(tmp_path / "m.jsonl")).collect()] == [("train", 3, "loss", 0.5)]
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        tables.read_metrics(spark, str(tmp_path / "bad.jsonl")).collect()
    listing = spark.createDataFrame([("   PRE run_1/",), ("2024-01-01 5 file",)], "value string")
    assert [r.name for r in tables.parse_listing(listing).collect()] == ["run_1"]
    nested = spark.createDataFrame([((1, (2,)),)], "a struct<b:int,c:struct<d:int>>")
    assert tables.flattened(nested).columns == ["a/b", "a/c/d"]
    tables.write_csv(spark.createDataFrame([([1, 2], "x")], "a array<int>, b string"), str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).first().a == "[1,2]"
    old = spark.createDataFrame([("ok", 1)], "status string, x int")
    assert tables.typed_records(old, {"ok": "passed"}).first().quality_status == "passed"


def test_recipes(spark):
    from framegrain.operators import episodes

    rows = spark.createDataFrame([(0, 0, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], 0.1), (0, 1, [0.01, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], 0.2), (1, 0, [0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 2.0], 0.3)], "e int, i int, p array<double>, q array<double>, g double")
    out = episodes.local_actions(rows, "p", "q", "g", "e", ["i"], (0.02, 0.06, 1.0)).orderBy("e", "i").collect()
    assert out[0].action == pytest.approx([0.5, 0, 0, 0, 0, 0, 0.2]) and out[1].action == out[0].action and out[2].action == pytest.approx([0] * 6 + [0.3])
    cams = spark.createDataFrame([(["right_wrist", "cam_high", "left_x"],), ([],)], "c array<string>").select(episodes.camera_roles(F.col("c")).alias("r")).collect()
    assert tuple(cams[0].r) == ("cam_high", "left_x", "right_wrist", "right_wrist") and tuple(cams[1].r) == (None,) * 4
    same = spark.createDataFrame([(1, [float(i % 7) / 7 for i in range(64)])], "k int, a array<double>").withColumn("b", F.col("a"))
    assert episodes.structural_similarity(same, ["k"], "a", "b", 8).first().ssim == pytest.approx(1.0)
    tens = [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.5]
    turned = [0.3, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0]
    e = spark.createDataFrame([(tens, turned)], "a array<double>, b array<double>").select(episodes.arm_errors(F.col("a"), F.col("b")).alias("e")).first().e
    assert e.translation == pytest.approx(0.1) and e.rotation_degrees == pytest.approx(90) and e.gripper == 0.5
    with pytest.raises(Exception, match="no mask"):
        spark.range(1).select(episodes.loss_masks(F.lit("x"), {"y": [True]})).collect()
    with pytest.raises(Exception, match="arm is missing"):
        spark.createDataFrame([([1.0], None)], "a array<double>, b array<double>").select(episodes.both_arms("a", "b")).collect()
