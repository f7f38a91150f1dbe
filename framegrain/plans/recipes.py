"""Queries of the episode recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegrain.functions import geometry
from framegrain.operators import episodes, frames
from framegrain.plans.registry import EV, ORDER, query, r6, read, read_events, read_frames


@query("""SELECT user_id, count(*) FILTER (value > 20) AS positive, count(*) FILTER (value <= 20) AS negative FROM events GROUP BY user_id""")
def reward_counts(spark, sf_dir):
    """FLT-04"""
    return episodes.reward_counts(read_events(spark, sf_dir), "user_id", "value", 20.0)


@query(f"""WITH {EV}, k AS (SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS episode FROM ev WHERE value > 60) SELECT event_id, episode, 0::BIGINT AS frame_index FROM k""")
def single_frame_episodes(spark, sf_dir):
    """WIN-21"""
    def numbering(rows):
        return frames.global_index(frames.number_frames(rows, "user_id", ORDER), "user_id").withColumn("episode", F.col("index"))

    return episodes.single_frame_episodes(read_events(spark, sf_dir), F.col("value") > 60, "user_id", ORDER, numbering).select("event_id", "episode", "frame_index")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) / 3600e6 - lag(epoch_us(ts) / 3600e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) SELECT user_id, round_even(1 / quantile_cont(s, 0.5), 0)::BIGINT AS fps FROM s WHERE s > 0 GROUP BY user_id""")
def source_rate(spark, sf_dir):
    """AGG-32"""
    rows = read_events(spark, sf_dir).withColumn("hours", F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6)
    return episodes.source_fps(rows, "hours", "user_id", ORDER)


@query("""WITH c AS (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY lang, source) SELECT lang, arg_max(source, (n, -f)) AS source FROM c GROUP BY lang""")
def first_mode(spark, sf_dir):
    """AGG-36"""
    return episodes.first_mode(read(spark, sf_dir, "documents"), ["lang"], "source", "doc_id")


@query("""WITH c AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS code FROM events GROUP BY event_type) SELECT user_id, list(DISTINCT code ORDER BY code) AS tasks FROM events JOIN c USING (event_type) GROUP BY user_id""")
def task_table(spark, sf_dir):
    """AGG-30"""
    rows = read_events(spark, sf_dir).withColumn("task", F.concat(F.lit("["), "event_type", F.lit("]")))
    return episodes.task_table(rows, "user_id", "task", "event_id")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS l_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS l_tax FROM lineitem GROUP BY 1, 2""")
def condition_report(spark, sf_dir):
    """AGG-40"""
    out = episodes.condition_report(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"], "l_quantity")
    return out.withColumn("l_discount", r6(F.col("l_discount"))).withColumn("l_tax", r6(F.col("l_tax")))


@query("""WITH z AS (SELECT DISTINCT event_type, event_id // 50 AS s FROM events WHERE value < 1) SELECT event_type AS mode, event_id // 50 AS global_step, value FROM events WHERE event_type IN ('click', 'view') AND (event_type, event_id // 50) NOT IN (SELECT event_type, s FROM z)""")
def metric_series(spark, sf_dir):
    """FLT-08"""
    rows = read_events(spark, sf_dir).select(F.col("event_type").alias("mode"), F.expr("event_id div 50").alias("global_step"), F.lit("loss").alias("metric"), "value")
    support = rows.filter("value < 1").select("mode", "global_step", F.lit("samples").alias("metric"), F.lit(0.0).alias("value"))
    return episodes.metric_series(rows.unionByName(support), "loss", ["click", "view"], {"samples": 0})


@query("""SELECT event_id, user_id FROM events ORDER BY user_id DESC, length(props) DESC, event_id LIMIT 1""")
def latest_report(spark, sf_dir):
    """SRT-02"""
    rows = read_events(spark, sf_dir).withColumn("k", F.length("props"))
    return episodes.latest_report(rows, "user_id", "k", "event_id").select("event_id", "user_id")


@query("""WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(avg(abs(x - y)), 6) AS mae, round(max(abs(x - y)), 6) AS max_abs, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, count(*) FILTER (x <> y)::INTEGER AS different FROM p GROUP BY vec_id""")
def array_difference(spark, sf_dir):
    """JON-10, AGG-28"""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    out = v.join(nxt, "vec_id").select("vec_id", episodes.array_difference(F.col("a"), F.col("b")).alias("d")).select("vec_id", "d.*")
    return out.select("vec_id", *[r6(F.col(c)).alias(c) for c in ("mae", "max_abs", "rmse")], "different")


@query("""WITH l AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.01 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.n IS NULL THEN 'right missing' WHEN l.n IS NULL THEN 'left missing' ELSE 'lengths differ' END AS issue FROM l FULL JOIN r ON l.k = r.k WHERE l.n IS DISTINCT FROM r.n""")
def peer_issues(spark, sf_dir):
    """AUD-01"""
    rows = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' OR (l_returnflag = 'R' AND l_tax > 0.01)")
    rows = rows.groupBy(F.col("l_suppkey").alias("k"), F.when(F.col("l_returnflag") == "A", "left").otherwise("right").alias("side")).agg(F.count(F.lit(1)).alias("n"))
    return episodes.peer_issues(rows, "k", "side", "n")


@query("""SELECT vec_id, embedding[1]::DOUBLE AS left_x, embedding[9]::DOUBLE AS right_x, embedding[16]::DOUBLE AS right_gripper, CASE label % 3 WHEN 0 THEN [true, false] WHEN 1 THEN [false, true] ELSE [true, true] END AS mask FROM embeddings""")
def arm_channels(spark, sf_dir):
    """PRJ-06, PRJ-12, FLT-10"""
    names = episodes.channel_names(["left", "right"], episodes.STATE_CHANNELS)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice(v, 1, 8).alias("a"), F.slice(v, 9, 8).alias("b")).withColumn("state", episodes.both_arms("a", "b"))
    kind = F.concat(F.lit("k"), (F.col("label") % 3).cast("string"))
    masks = episodes.loss_masks(kind, {"k0": [True, False], "k1": [False, True], "k2": [True, True]})
    return episodes.named_channels(rows, "state", names).select("vec_id", "left_x", "right_x", "right_gripper", masks.alias("mask"))


@query(f"""WITH {EV} SELECT event_id, true AS reaches_next, 7 AS width FROM ev WHERE frame_index < n - 1""")
def local_actions(spark, sf_dir):
    """WIN-03, MTH-04, AUD-08: Encoded steps decode to the next frame's pose."""
    turn = F.col("value") / 200
    rows = read_frames(spark, sf_dir).select(
        "event_id", "user_id", "ts", "frame_index", "episode_length", F.array(F.col("value") / 100, F.lit(0.0), F.col("frame_index") / 100.0).alias("p"),
        F.array(F.lit(0.0), F.lit(0.0), F.sin(turn / 2), F.cos(turn / 2)).alias("q"), F.lit(0.5).alias("g"),
    )
    rows = episodes.ENCODERS["euler"](rows, position="p", quaternion="q", gripper="g", episode="user_id", order=ORDER, scales=(100.0, 4.0, 1.0))
    back = geometry.decode_action(F.col("action"), 100.0, 4.0, 1.0)
    rows = rows.withColumn("m", geometry.quaternion_to_matrix(F.col("q"))).withColumn("to", geometry.advanced(F.col("p"), F.col("m"), back))
    nxt = rows.select("user_id", (F.col("frame_index") - 1).alias("frame_index"), F.col("p").alias("p1"), F.col("m").alias("m1"))
    near = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))) < 1e-9
    return rows.join(nxt, ["user_id", "frame_index"]).select("event_id", (near("to.position", "p1") & near("to.rotation", "m1")).alias("reaches_next"), F.size("action").alias("width"))


@query("""WITH p AS (SELECT a.vec_id, unnest(range(64)) AS k, (unnest(a.embedding)::DOUBLE + 1) / 2 AS x, (unnest(b.embedding)::DOUBLE + 1) / 2 AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
w AS (SELECT vec_id, r, c, avg(x) AS mx, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS vx, avg(y * y) - avg(y) * avg(y) AS vy, avg(x * y) - avg(x) * avg(y) AS vxy FROM p, range(2) t(r), range(2) u(c) WHERE k // 8 BETWEEN r AND r + 6 AND k % 8 BETWEEN c AND c + 6 GROUP BY vec_id, r, c)
SELECT vec_id, round(avg((2 * mx * my + 1e-4) * (2 * vxy + 9e-4) / ((mx * mx + my * my + 1e-4) * (vx + vy + 9e-4))), 6) AS ssim FROM w GROUP BY vec_id""")
def image_similarity(spark, sf_dir):
    """AGG-21"""
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("a"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return episodes.structural_similarity(v.join(nxt, "vec_id"), ["vec_id"], "a", "b", 8).withColumn("ssim", r6(F.col("ssim")))
