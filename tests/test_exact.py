"""Results that must not change with the number of rows or with hard values."""

import duckdb
from pyspark.sql import functions as F

from framegrain.functions import geometry
from framegrain.operators import episodes, metrics, scans, stats
from framegrain.plans.catalogue import ORACLES, QUERIES
from framegrain.sources import rowgroups, tables


def test_bootstrap_median_of_many_episodes(spark):
    n = 120_001
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("e"), (F.hash("id").cast("double") + F.col("id") / 1e6).alias("v"))
    want = sorted(r.v for r in df.select("v").collect())[n // 2]
    got = metrics.bootstrap_interval(df, "e", "v", ["k"], resamples=4).first()
    assert got.median == want and got.episodes == n and got.low <= got.high


def test_bootstrap_draws_as_documented(spark):
    import hashlib

    df = spark.createDataFrame([("a", e, float(e)) for e in range(5)] + [(None, 2, 7.0), ("a", 3, float("nan"))], "k string, e long, v double")
    rows = {r.k: r for r in metrics.bootstrap_interval(df, "e", "v", ["k"], resamples=4).collect()}
    times = lambda e, r: sum(p <= int(hashlib.md5(f"42:{e}:0".encode()).hexdigest()[7 * r : 7 * r + 7], 16) / (1 << 28) for p in metrics.POISSON)
    drawn = sorted(sum(times(e, r) * e for e in range(5)) / sum(times(e, r) for e in range(5)) for r in range(4) if sum(times(e, r) for e in range(5)))
    assert drawn[0] <= rows["a"].low <= drawn[1] and drawn[-2] <= rows["a"].high <= drawn[-1]
    assert rows["a"].median == 2.0 and rows["a"].episodes == 5 and rows[None].mean == 7.0 and rows[None].low == 7.0


def test_counted_quantiles_are_exact(spark):
    df = spark.range(50_000).select((F.col("id") % 7).alias("shard"), F.when(F.col("id") % 2 == 0, "a").alias("g"), F.hash("id").cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([(0, "a", None), (1, None, float("nan")), (1, "b", 3.0)], "shard long, g string, v double"))
    got = {r.g: r for r in stats.counted_quantiles(stats.value_counts(df, "v", ["g", "shard"]), ["g"], "v", {"least": 0.0, "low": 0.25, "top": 1.0}).collect()}
    for g, parity in (("a", 0), (None, 1)):
        v = sorted(r.v for r in df.filter(F.col("g").eqNullSafe(F.lit(g)) & F.col("v").isNotNull() & ~F.isnan("v")).collect())
        assert (got[g].n, got[g].least, got[g].low, got[g].top) == (25_000, v[0], v[6_249], v[-1])
    assert (got["b"].n, got["b"].low) == (1, 3.0)


def test_matrices_near_half_turns_and_right_angles(spark):
    import math

    cases = [(0.5, 0.5, 0.5, 2e-4), (0.6, -0.7, 0.3, -2e-4), (0.0, 1.0, 0.0, 1e-3), (1.0, 0.0, 0.0, 0.0), (-1.0, 2.0, -3.0, 0.0)]
    cases += [(0.0, math.sin(a / 2), 0.0, math.cos(a / 2)) for a in (math.pi / 2, math.pi / 2 - 1e-5, -math.pi / 2 + 1e-7, math.pi / 2 - 1e-9)]
    cases += [(0.5, 0.5, -0.5, 0.5 + e) for e in (0.0, 1e-4, 1e-9)] + [(0.3, 0.2, -0.1, 0.9)]
    rows = spark.createDataFrame([(list(q),) for q in cases], "q array<double>").withColumn("m", geometry.quaternion_to_matrix(F.col("q")))
    back = geometry.matrix_to_quaternion(F.col("m"))
    gap = F.array_max(F.zip_with(geometry.euler_to_matrix(geometry.matrix_to_euler(F.col("m"))), F.col("m"), lambda a, b: F.abs(a - b)))
    for r in rows.select("q", back.alias("back"), geometry.quaternion_distance(back, geometry.unit(F.col("q"))).alias("d"), gap.alias("gap")).collect():
        assert r.d < 1e-14 and r.gap < 1e-14 and r.back[3] >= 0, r


def _embeddings(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return duck


def _same(spark, duck, name, path):
    df = QUERIES[name](spark, str(path))
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(map(repr, want))


def test_small_values_and_bounds_as_in_sql(spark, tmp_path):
    small = [-1e-7, 1e-7, -0.0, 0.0, -4.9e-7, -0.15, 0.15, -0.2, 0.2, 0.14999998, -0.15000002, 1.5, -2.5]
    duck = _embeddings(spark, tmp_path, [(i, [small[(i + k) % len(small)] for k in range(64)], i % 3) for i in range(len(small))])
    for name in ("plane_slices", "source_arrays", "bounds_violation"):
        _same(spark, duck, name, tmp_path)


def test_quota_of_more_episodes_than_samples(spark, tmp_path):
    spark.range(3_300).select("id", (F.col("id") % 1_100).alias("user_id")).withColumnRenamed("id", "event_id").selectExpr("event_id", "TIMESTAMP_NTZ '2024-01-01' AS ts", "user_id", "'click' AS event_type", "1D AS value", "'' AS props").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    _same(spark, duck, "quota_per_episode", tmp_path)


def test_rows_of_files_with_many_groups(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(30_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).repartitionByRange(2, "id").write.option("parquet.block.size", 1 << 12).parquet(path)
    asked = spark.read.parquet(path).select(F.col("id").alias("want"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row_index"))
    asked = asked.unionByName(asked.filter("want % 100 = 0"))
    groups = rowgroups.row_groups(asked.select("path").distinct())
    assert groups.count() > 50
    got = rowgroups.rows_at(asked, groups, "id long, s string")
    assert got.count() == 30_300 and got.filter("id <> want OR s <> sha2(CAST(want AS STRING), 256)").isEmpty()
    # A footer is read once a task, not once a group.
    assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString()


def test_nested_rotations_stay_small(spark):
    pose, later = F.col("a"), F.col("b")
    turned = lambda c: geometry.six_to_matrix(F.slice(c, 4, 6))
    moved = lambda c: geometry.quaternion_to_matrix(F.slice(c, 4, 4))
    # Two norms for each of two pairs of columns; one for each quaternion.
    assert str(geometry.angle_between(turned(pose), turned(later))).lower().count("sqrt") <= 4
    assert str(episodes.arm_errors(pose, later)).lower().count("sqrt") <= 4
    step = geometry.local_delta(F.slice(pose, 1, 3), moved(pose), F.slice(later, 1, 3), moved(later))
    for six in (True, False):
        assert str(geometry.encode_action(step, F.col("g"), 1.0, 1.0, 1.0, six=six)).lower().count("sqrt") <= 2


def test_scan_of_many_short_blocks(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # blocks that lie in two batches
    try:
        df = spark.range(3_000).select(F.when(F.col("id") % 30 > 0, F.col("id") % 30).alias("e"), F.floor(F.col("id") / 30).alias("i"), F.array(F.col("id") % 5 - 2.0, F.lit(-3.0), F.lit(4.0)).alias("v"))
        out = scans.ordered_scan(df, "v", scans.CLAMPS, "e", "i", "p", 8)
        assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()
        rows = {}
        for r in sorted(out.collect(), key=lambda r: r.i):
            rows.setdefault(r.e, []).append(r)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 30
    for some in rows.values():
        assert [r.i for r in some] == list(range(100))
        x = 1.0
        for r in some:
            x = min(4.0, max(-3.0, x + r.v[0]))
            assert min(r.p[2], max(r.p[1], 1.0 + r.p[0])) == x


def test_chosen_episodes_list_their_folders_only(spark, tmp_path):
    root = f"{tmp_path}/t"
    tables.write_episodes(spark.range(120).select((F.col("id") % 40).alias("episode_index"), F.floor(F.col("id") / 40).alias("frame_index")), root, chunk=7)
    rows = tables.read_episodes(spark, root, [3, 39, 1_000])
    assert len(rows.inputFiles()) == 2 and set(rows.columns) == {"episode_chunk", "episode_index", "frame_index"}
    assert {(r.episode_index, r.episode_chunk): r["count"] for r in rows.groupBy("episode_index", "episode_chunk").count().collect()} == {(3, 0): 3, (39, 5): 3}
    for none in ([], [1_000]):
        assert tables.read_episodes(spark, root, none).count() == 0
    assert tables.read_episodes(spark, root).count() == 120
