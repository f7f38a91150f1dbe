"""Queries of sources, sinks, projections, geometry and audits. The ids name what each covers in the blueprint."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from framegrain.functions import geometry, text
from framegrain.operators import datasets, episodes, frames, governance, joins, metrics, sampling, scans, sets, stats
from framegrain.plans.registry import EV, ORDER, query, r6, read, read_events, read_frames
from framegrain.plans.steps import REGISTRY, Pipeline, load_plugins
from framegrain.session import shared_dir
from framegrain.sources import journal, tables, versions


def _place(spark) -> str:
    return f"{shared_dir(spark)}/framegrain/tables-{uuid.uuid4().hex}"


def _vectors(spark, sf_dir, *names):
    return read(spark, sf_dir, "embeddings").select("vec_id", *names, F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def _each(v, digits=6):
    """An array rounded, without negative zeros."""
    return F.transform(v, lambda x: F.round(x, digits) + 0.0)


def _signed(x, digits=6):
    """A double rounded; what rounds to zero keeps its sign, as in SQL."""
    below = (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))
    return F.when(below, -F.round(-x, digits)).otherwise(F.round(x, digits))


def _each_signed(v, digits=6):
    return F.transform(v, lambda x: _signed(x, digits))


def _list(sql, digits=6):
    return f"list_transform({sql}, lambda x: round(x, {digits}) + 0.0)"


# --- text and maps -----------------------------------------------------------------------------------------


@query("""SELECT page_id, url AS target, 'page "' || page_id || '"' AS label FROM pages""")
def hyperlink_parts(spark, sf_dir):
    """STR-01"""
    formula = F.concat(F.lit('=HYPERLINK("'), "url", F.lit('"; "page ""'), "page_id", F.lit('""")'))
    return read(spark, sf_dir, "pages").select("page_id", text.hyperlink(formula).alias("target"), text.hyperlink(formula, label=True).alias("label"))


@query("""SELECT o_orderkey, (o_orderdate + INTERVAL 120 MONTH)::DATE AS day, 'root/' || lower(o_orderstatus) AS rest FROM orders""")
def batch_dates(spark, sf_dir):
    """STR-04, STR-05, DAT-01: the last date of a batch's name, and the name without robot and date."""
    day = F.date_format(F.add_months("o_orderdate", 120), "yyyyMMdd")
    status = F.lower("o_orderstatus")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.last_date(F.concat(F.lit("a_20991399_20010101_"), day)).alias("day"), F.concat(F.lit("root/"), text.without_affixes(F.concat(F.lit("arx_"), status, F.lit("_"), day), ["arx", "x5"])).alias("rest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN lang END AS station, CASE WHEN doc_id % 3 >= 1 THEN source END AS task, 'b' || doc_id % 7 AS batch, 'e' || doc_id AS episode FROM documents""")
def path_layouts(spark, sf_dir):
    """STR-06"""
    end = F.concat(F.lit("b"), F.col("doc_id") % 7, F.lit("/e"), "doc_id", F.lit("/f.hdf5"))
    path = F.when(F.col("doc_id") % 3 == 0, end).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "source", end)).otherwise(F.concat_ws("/", "lang", "source", end))
    return read(spark, sf_dir, "documents").select("doc_id", text.layout(path).alias("l")).select("doc_id", "l.*")


@query("""SELECT p_partkey, 'ep' || p_partkey AS episode, regexp_replace(p_name || p_size || 'x' || p_partkey, '[0-9]+', '#', 'g') AS signal FROM part""")
def source_names(spark, sf_dir):
    """STR-07"""
    path = F.concat(F.lit("/raw/c/ep"), "p_partkey", F.when(F.col("p_size") > 20, F.lit("/data")).otherwise(F.lit("")), F.lit("/trajectory.hdf5"))
    return read(spark, sf_dir, "part").select("p_partkey", datasets.episode_of(path).alias("episode"), text.collapsed(F.concat("p_name", "p_size", F.lit("x"), "p_partkey")).alias("signal"))


@query("""WITH p AS (SELECT source, CASE WHEN bool_or(text LIKE '%.partial%') THEN 'partial' END AS q, bool_or(lang IN ('en', 'de')) AS deep, bool_and(lang IN ('en', 'de')) AS all_deep FROM documents WHERE n_chars > 6000 GROUP BY source)
SELECT source, CASE WHEN q IS NOT NULL THEN q WHEN NOT deep THEN 'flat' WHEN all_deep THEN 'nested' ELSE 'mixed' END AS kind FROM p""")
def path_structures(spark, sf_dir):
    """STR-10"""
    rows = read(spark, sf_dir, "documents").filter("n_chars > 6000")
    path = F.concat(F.when(F.col("lang").isin("en", "de"), F.lit("d/")).otherwise(F.lit("")), "doc_id", F.when(F.col("text").contains(".partial"), F.lit(".partial")).otherwise(F.lit("")))
    return rows.groupBy("source").agg(text.structure(F.collect_list(path)).alias("kind"))


@query("""SELECT doc_id, sha256('{"doc":"' || doc_id || '","lang":"' || lang || '","source":"' || source || '"}') AS fingerprint FROM documents""")
def canonical_fingerprint(spark, sf_dir):
    """STR-12, JSN-01"""
    m = F.create_map(F.lit("source"), F.col("source"), F.lit("doc"), F.col("doc_id").cast("string"), F.lit("lang"), F.col("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.canonical_map(m), 256).alias("fingerprint"))


@query("""SELECT c_custkey, c_mktsegment AS segment, c_nationkey::DOUBLE AS nation, NULL::DOUBLE AS flag FROM customer""")
def key_value_maps(spark, sf_dir):
    """MAP-01, MAP-02: numbers are looked up by type; text and booleans are none."""
    m = text.pairs(F.concat(F.lit("segment="), "c_mktsegment", F.lit(",nation="), "c_nationkey", F.lit(",flag=true")))
    return read(spark, sf_dir, "customer").select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")["segment"].alias("segment"), text.number_at(F.col("m"), "nation").alias("nation"), text.number_at(F.col("m"), "flag").alias("flag"))


# --- vectors and poses -------------------------------------------------------------------------------------

LONG = "long AS (SELECT vec_id, label, unnest(range(64))::INTEGER AS channel, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"""WITH {LONG}, s AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY channel) SELECT vec_id, round(sum((value - m) / (s + 1e-8)), 5) AS total, round(max(abs((value - m) / (s + 1e-8))), 6) AS widest, true AS exact FROM long JOIN s USING (channel) GROUP BY vec_id""")
def standardise_roundtrip(spark, sf_dir):
    """MTH-11"""
    v = _vectors(spark, sf_dir)
    per = stats.channel_stats(v, "v", [])
    both = stats.vector_of(per, [], "mean").crossJoin(stats.vector_of(per, [], "std"))
    rows = v.crossJoin(F.broadcast(both)).withColumn("x", stats.standardise("v", F.col("mean"), F.col("std")))  # one row of 64 channels
    back = stats.unstandardise("x", F.col("mean"), F.col("std"))
    error = F.array_max(F.zip_with(back, "v", lambda a, b: F.abs(a - b)))
    return rows.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), r6(F.array_max(F.transform("x", F.abs))).alias("widest"), (error < 1e-6).alias("exact"))


@query(f"""SELECT vec_id, {_list("list_concat(list_concat(embedding[1:3]::DOUBLE[], [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]::DOUBLE[]), embedding[7:]::DOUBLE[])")} AS wide FROM embeddings""")
def widened_stats(spark, sf_dir):
    """MTH-13"""
    return _vectors(spark, sf_dir).select("vec_id", _each(stats.widened(F.col("v"), 3, 6, 1.0)).alias("wide"))


@query(f"""SELECT vec_id, {_list("list_transform(embedding[1:4]::DOUBLE[], lambda x: abs(x) * 255 / 127.5 - 1)")} AS unit, {_list("list_concat(embedding[1:3], embedding[1:3])[1:5]::DOUBLE[]")} AS plane FROM embeddings""")
def pixels_and_planes(spark, sf_dir):
    """MTH-15, MTH-16"""
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", _each(geometry.pixels_to_unit(F.transform(F.slice("v", 1, 4), lambda x: F.abs(x) * 255))).alias("unit"), _each(geometry.tiled(F.slice("v", 1, 3), 5)).alias("plane"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(least(list_max(list_transform(range(1, 5), lambda i: abs(x[i]::DOUBLE - y[i]::DOUBLE))), list_max(list_transform(range(1, 5), lambda i: abs(x[i]::DOUBLE + y[i]::DOUBLE)))), 6) AS distance,
  sqrt(list_sum(list_transform(range(1, 65), lambda i: (x[i]::DOUBLE - y[i]::DOUBLE) * (x[i]::DOUBLE - y[i]::DOUBLE)))) < 1.4 AS similar FROM p""")
def quaternion_and_state_distance(spark, sf_dir):
    """MTH-17, MTH-20"""
    v = _vectors(spark, sf_dir)
    rows = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return rows.select("vec_id", r6(geometry.quaternion_distance(F.slice("v", 1, 4), F.slice("w", 1, 4))).alias("distance"), geometry.close_to(F.col("v"), F.col("w"), 1.4).alias("similar"))


QUATERNION = "q AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz, embedding[4] / n AS x, embedding[5] / n AS y, embedding[6] / n AS z, embedding[7] / n AS w FROM (SELECT *, sqrt(embedding[4]::DOUBLE ** 2 + embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2 + embedding[7]::DOUBLE ** 2) AS n FROM embeddings))"


@query(f"""WITH {QUATERNION} SELECT vec_id, round(px, 6) AS x, round(pz, 6) AS z, round(atan2(2 * (y * z + x * w), 1 - 2 * (x * x + y * y)), 5) AS roll, round(asin(greatest(-1, least(1, -2 * (x * z - y * w)))), 5) AS pitch, round(atan2(2 * (x * y + z * w), 1 - 2 * (y * y + z * z)), 5) AS yaw, true AS pose_ok FROM q""")
def pose_eulers(spark, sf_dir):
    """MTH-22, MTH-23"""
    rows = _vectors(spark, sf_dir).withColumn("pose", F.slice("v", 1, 7)).withColumn("e", geometry.pose_to_euler(F.col("pose"))).withColumn("m", geometry.pose_parts(F.col("pose")))
    same = geometry.quaternion_distance(geometry.matrix_to_quaternion(F.col("m.rotation")), geometry.unit(F.slice("pose", 4, 4))) < 1e-9
    at = lambda i: F.get("e", F.lit(i))
    return rows.select("vec_id", r6(at(0)).alias("x"), r6(at(2)).alias("z"), *[F.round(at(3 + i), 5).alias(n) for i, n in enumerate(("roll", "pitch", "yaw"))], same.alias("pose_ok"))


#: Two turning joints in a plane and a sliding one at their end.
CHAIN = [{"kind": "revolute"}, {"kind": "fixed", "xyz": (0.3, 0, 0)}, {"kind": "continuous", "sign": -1, "offset": 0.1}, {"kind": "prismatic", "xyz": (0.2, 0, 0), "axis": (2, 0, 0)}]
JOINTS = "j AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, 0.1 - embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)"


@query(f"""WITH {JOINTS} SELECT vec_id, round(0.3 * cos(a) + (0.2 + c) * cos(a + b), 6) AS x, round(0.3 * sin(a) + (0.2 + c) * sin(a + b), 6) AS y, round(cos(a + b), 6) AS r0, round(sin(a + b), 6) AS r3 FROM j""")
def chain_kinematics(spark, sf_dir):
    """MTH-08"""
    rows = _vectors(spark, sf_dir).withColumn("end", geometry.forward_kinematics(F.col("v"), CHAIN))
    at = lambda c, i: r6(F.get(c, F.lit(i)))
    return rows.select("vec_id", at("end.position", 0).alias("x"), at("end.position", 1).alias("y"), at("end.rotation", 0).alias("r0"), at("end.rotation", 3).alias("r3"))


@query(f"""WITH {JOINTS}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS m FROM j), k AS (SELECT DISTINCT label, round_even(u * (m - 1) / (least(m, 20) - 1), 0)::BIGINT AS i FROM n, range(20) t(u) WHERE u < least(m, 20))
SELECT label, count(*) AS frames, round(max(abs(c)) / 100, 6) AS max_error, round(avg(abs(c)) / 100, 6) AS mean_error FROM n JOIN k USING (label, i) GROUP BY label""")
def kinematics_audit(spark, sf_dir):
    """AGG-31: recorded positions lie a hundredth of the third joint beside the chain's end."""
    rows = _vectors(spark, sf_dir, "label")
    end = geometry.forward_kinematics(F.col("v"), CHAIN)["position"]
    rows = rows.withColumn("recorded", F.zip_with(end, F.array(F.lit(0.0), F.lit(0.0), F.get("v", F.lit(2)) / 100), lambda a, b: a + b))
    return _rounded(episodes.kinematics_error(rows, "v", "recorded", CHAIN, "label", ["vec_id"], 20), "max_error", "mean_error")


#: Planar poses of frames: place, heading and gripper from the value, and those of the next frame.
PLANAR = f"""{EV}, p AS (SELECT event_id, user_id, frame_index, n, value / 100 AS x, frame_index / 50.0 AS y, value / 200 AS a, value / 300 AS g FROM ev),
s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(a) OVER w AS a1, lead(g) OVER w AS g1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY frame_index))"""


def _planar(spark, sf_dir):
    a = F.col("value") / 200
    pose = F.array(F.col("value") / 100, F.col("frame_index") / 50.0, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.sin(a / 2), F.cos(a / 2))
    rows = read_frames(spark, sf_dir).select("event_id", "user_id", "frame_index", pose.alias("pose"), (F.col("value") / 300).alias("g"))
    nxt = rows.select("user_id", (F.col("frame_index") - 1).alias("frame_index"), F.col("pose").alias("pose1"), F.col("g").alias("g1"))
    return rows.join(nxt, ["user_id", "frame_index"])


@query(f"""WITH {PLANAR} SELECT event_id, {_list("list_transform([(cos(a) * (x1 - x) + sin(a) * (y1 - y)) / 3, (cos(a) * (y1 - y) - sin(a) * (x1 - x)) / 3, 0, 0, 0, atan2(sin(a1 - a), cos(a1 - a)) / 2, (g1 - g) / 1.5], lambda v: greatest(-1.0, least(1.0, v)))")} AS action FROM s WHERE a1 IS NOT NULL""")
def difference_actions(spark, sf_dir):
    """MTH-14: the gripper is a difference here."""
    return _planar(spark, sf_dir).select("event_id", _each(geometry.difference_action(F.col("pose"), F.col("pose1"), F.col("g"), F.col("g1"), 3.0, 2.0, 1.5)).alias("action"))


@query(f"""WITH {PLANAR} SELECT event_id, {_list("[cos(a), sin(a), 0, -sin(a), cos(a), 0]")} AS rotation_6d, {_list("[cos(a1 - a), sin(a1 - a), 0, -sin(a1 - a), cos(a1 - a), 0]")} AS delta_rotation_6d,
  {_list("[cos(a) * (x1 - x) + sin(a) * (y1 - y), cos(a) * (y1 - y) - sin(a) * (x1 - x), 0, 0, 0, atan2(sin(a1 - a), cos(a1 - a))]")} AS delta_xyz_euler, {_list("[x1 - x, g1 - g]")} AS delta_joints, round(g1, 6) AS target_gripper FROM s WHERE a1 IS NOT NULL""")
def action_audit_fields(spark, sf_dir):
    """MTH-07"""
    joints = lambda p, g: F.array(F.get(p, F.lit(0)), F.col(g))
    fields = geometry.audit_fields(F.col("pose"), F.col("pose1"), F.col("g"), F.col("g1"), joints("pose", "g"), joints("pose1", "g1"))
    rows = _planar(spark, sf_dir).select("event_id", fields.alias("f"))
    return rows.select("event_id", *[_each(F.col(f"f.{c}")).alias(c) for c in ("rotation_6d", "delta_rotation_6d", "delta_xyz_euler", "delta_joints")], r6(F.col("f.target_gripper")).alias("target_gripper"))


@query(f"""WITH {PLANAR} SELECT event_id, {_list("[greatest(-1.0, least(1.0, (cos(a) * (x1 - x) + sin(a) * (y1 - y)) / 4)), cos(a1 - a), sin(a1 - a), greatest(0.0, least(1.0, g1 / 2))]")} AS six, round(greatest(-1.0, least(1.0, atan2(sin(a1 - a), cos(a1 - a)) / 3)), 6) AS yaw FROM s WHERE a1 IS NOT NULL""")
def action_strategies(spark, sf_dir):
    """UDF-04: the step to a target pose of the same frame, in both encodings."""
    rows = _planar(spark, sf_dir)
    for name in ("pose", "pose1"):
        rows = rows.withColumn(f"p_{name}", F.slice(name, 1, 3)).withColumn(f"q_{name}", F.slice(name, 4, 4))
    given = {"position": "p_pose", "quaternion": "q_pose", "target_position": "p_pose1", "target_quaternion": "q_pose1", "gripper": "g1", "scales": (4.0, 3.0, 2.0)}
    rows = episodes.STRATEGIES["same_frame", "six"](rows, **given).withColumnRenamed("action", "s")
    rows = episodes.STRATEGIES["same_frame", "euler"](rows, **given)
    six = F.array(*[F.get("s", F.lit(i)) for i in (0, 3, 4, 9)])
    return rows.select("event_id", _each(six).alias("six"), r6(F.get("action", F.lit(5))).alias("yaw"))


@query("""WITH RECURSIVE j AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT vec_id, round(greatest(-1.0, least(1.0, 0.3 * sin(b) / 2)), 6) AS y, round(b, 6) AS turn FROM j""")
def joint_strategy(spark, sf_dir):
    """UDF-04: the step from where joints are to where they are to be; the second joint's turn moves the end of the first link."""
    chain = [{"kind": "revolute"}, {"kind": "fixed", "xyz": (0.3, 0, 0)}]
    rows = _vectors(spark, sf_dir).withColumn("j", F.array(F.get("v", F.lit(0)))).withColumn("t", F.array(F.get("v", F.lit(0)) + F.get("v", F.lit(1)))).withColumn("g", F.lit(0.5))
    rows = episodes.STRATEGIES["joints", "euler"](rows, joints="j", target_joints="t", chain=chain, gripper="g", scales=(2.0, 1.0, 1.0))
    return rows.select("vec_id", r6(F.get("action", F.lit(1))).alias("y"), r6(F.get("action", F.lit(5))).alias("turn"))


@query(f"""WITH {PLANAR}, c AS (SELECT *, CASE WHEN cos(a / 2) * lag(cos(a / 2)) OVER w + sin(a / 2) * lag(sin(a / 2)) OVER w < 0 THEN 1 ELSE 0 END AS flip FROM p WINDOW w AS (PARTITION BY user_id ORDER BY frame_index)),
f AS (SELECT *, CASE WHEN sum(flip) OVER (PARTITION BY user_id ORDER BY frame_index ROWS UNBOUNDED PRECEDING) % 2 = 1 THEN -1.0 ELSE 1.0 END AS sign FROM c)
SELECT event_id, {_list("[x / 5 - 1, y / 5 - 1, -1, 0, 0, sign * sin(a / 2), sign * cos(a / 2), 2 * g - 1]")} AS proprio FROM f""")
def proprio_vectors(spark, sf_dir):
    """MTH-24, WIN-07: headings of up to several turns, so signs flip."""
    a = F.col("value") / 200
    rows = read_frames(spark, sf_dir).select(
        "event_id", "user_id", "frame_index", F.array(F.col("value") / 100, F.col("frame_index") / 50.0, F.lit(0.0)).alias("p"),
        F.transform(F.array(F.lit(0.0), F.lit(0.0), F.sin(a / 2), F.cos(a / 2)), lambda x: x * 3).alias("q"), (F.col("value") / 300).alias("g"),
    )
    rows = episodes.proprio(rows, "p", "q", "g", "user_id", ["frame_index"], [0.0, 0.0, 0.0, -1.0, -1.0, -1.0, -1.0, 0.0], [10.0, 10.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])
    return rows.select("event_id", _each(F.col("proprio")).alias("proprio"))


@query(f"""WITH {EV}, d AS (SELECT user_id, frame_index, value / 100 AS step, value / 500 AS turn FROM ev), h AS (SELECT *, coalesce(sum(turn) OVER (PARTITION BY user_id ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d)
SELECT user_id, round(sum(step * cos(a)), 5) AS x, round(sum(step * sin(a)), 5) AS y, round(cos(sum(turn)), 5) AS c, count(*) + 1 AS poses FROM h GROUP BY user_id""")
def pose_integration(spark, sf_dir):
    """WIN-17: an ordered product of steps in blocks of 16 frames, so that episodes have several."""
    turn = F.col("value") / 500
    step = F.array(F.cos(turn), -F.sin(turn), F.lit(0.0), F.sin(turn), F.cos(turn), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("value") / 100, F.lit(0.0), F.lit(0.0))
    poses = scans.ordered_scan(read_frames(spark, sf_dir).select("user_id", "frame_index", step.alias("step")), "step", scans.POSES, "user_id", "frame_index", "pose", 16)
    last = poses.groupBy("user_id").agg(F.max_by("pose", "frame_index").alias("p"), (F.count(F.lit(1)) + 1).alias("poses"))
    at = lambda i: F.round(F.get("p", F.lit(i)), 5)
    return last.select("user_id", at(9).alias("x"), at(10).alias("y"), at(0).alias("c"), "poses")


@query(f"""WITH RECURSIVE {PLANAR},
a AS (SELECT user_id, frame_index + 1 AS i, n, x1, y1, a1, g1, greatest(-1.0, least(1.0, (cos(a) * (x1 - x) + sin(a) * (y1 - y)) / 1.5)) * 1.5 AS u, greatest(-1.0, least(1.0, (cos(a) * (y1 - y) - sin(a) * (x1 - x)) / 1.5)) * 1.5 AS v, greatest(-1.0, least(1.0, atan2(sin(a1 - a), cos(a1 - a)) / 0.5)) * 0.5 AS t, (g1 - g) * 2 AS h FROM s WHERE a1 IS NOT NULL),
w AS (SELECT user_id, frame_index AS i, x, y, a, least(1.0, greatest(0.0, g)) AS g FROM p WHERE frame_index = 0
UNION ALL SELECT a.user_id, a.i, x + cos(w.a) * u - sin(w.a) * v, y + sin(w.a) * u + cos(w.a) * v, w.a + t, least(1.0, greatest(0.0, w.g + h)) FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i + 1)
SELECT a.user_id, count(*) AS frames, round(max(sqrt((w.x - x1) ** 2 + (w.y - y1) ** 2)), 5) AS position, round(max(degrees(acos(greatest(-1.0, least(1.0, cos(w.a - a1)))))), 3) AS degrees, round(max(abs(w.g - g1)), 5) AS gripper
FROM w JOIN a ON a.user_id = w.user_id AND a.i = w.i GROUP BY a.user_id""")
def integration_roundtrip(spark, sf_dir):
    """AUD-08, WIN-17: encoded steps, clipped by their scales, integrated from the first pose and compared with the recorded ones."""
    rows = _planar(spark, sf_dir)
    action = geometry.difference_action(F.col("pose"), F.col("pose1"), F.col("g"), F.col("g1"), 1.5, 0.5, 0.5)
    named = lambda pose, grip: [F.slice(pose, 1, 3).alias("position"), geometry.quaternion_to_matrix(F.slice(pose, 4, 4)).alias("rotation"), F.col(grip).alias("gripper")]
    # The gripper's step is unclipped and doubled, so that the clipping after every frame matters.
    steps = F.concat(F.slice(action, 1, 6), F.array((F.col("g1") - F.col("g")) * 2))
    start = rows.filter("frame_index = 0").select("user_id", *named("pose", "g")).withColumn("gripper", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "gripper")))
    moved = scans.integrated(rows.select("user_id", "frame_index", steps.alias("action")), "action", start, (1.5, 0.5, 1.0), "user_id", "frame_index", block=16)
    out = scans.roundtrip_errors(moved, rows.select("user_id", "frame_index", *named("pose1", "g1")), "user_id", "frame_index")
    return out.select("user_id", "frames", F.round("position", 5).alias("position"), F.round("degrees", 3).alias("degrees"), F.round("gripper", 5).alias("gripper"))


@query("""SELECT vec_id, [round(x, 6) FOR x IN list_concat(embedding[19:22], embedding[27:30], embedding[35:38], embedding[43:46])::DOUBLE[]] AS middle, [round(x, 6) FOR x IN embedding[1:4]::DOUBLE[]] AS past, [round(x, 6) FOR x IN embedding[61:64]::DOUBLE[]] AS future, round(embedding[64]::DOUBLE, 6) AS last,
  [round(embedding[i]::DOUBLE, 6) FOR i IN [1, 4, 7, 25, 28, 31, 49, 52, 55]] AS sparse FROM embeddings""")
def plane_slices(spark, sf_dir):
    """MTH-21, PRJ-17, PRJ-18, AGG-41"""
    v = _vectors(spark, sf_dir).withColumn("r", geometry.named_ranges(F.col("v"), {"past": (0, 4), "future": (60, 64)}, 64))
    one = geometry.as_scalar(geometry.as_array(F.element_at("v", -1)))
    return v.select("vec_id", _each_signed(geometry.center(F.col("v"), 8, 8, 4)).alias("middle"), _each_signed(F.col("r.past")).alias("past"), _each_signed(F.col("r.future")).alias("future"), _signed(one).alias("last"), _each_signed(geometry.strided(F.col("v"), 8, 8, 3)).alias("sparse"))


@query("""WITH e AS (SELECT user_id, value / 200 AS a, value FROM events) SELECT user_id, round(avg(abs(0.1 * value / 100) / 3) + 1e-9, 5) AS translation, 0.0::DOUBLE AS rotation_degrees, round(avg(value / 1000) + 1e-9, 5) AS gripper, round(avg(((value / 300 >= 0.5) = (value / 300 + value / 1000 >= 0.5))::DOUBLE) + 1e-9, 5) AS gripper_accuracy, round(avg(abs(0.1 * value / 100) / 3) + 1e-9, 5) AS translation_at_1, round(avg(value / 1000) + 1e-9, 5) AS gripper_at_2 FROM e GROUP BY user_id""")
def arm_error_report(spark, sf_dir):
    """AGG-19: chunks of two frames whose predictions differ in one place and the gripper."""
    a, v = F.col("value") / 200, F.col("value")
    arm = lambda x, g: F.array(x, F.lit(0.0), F.lit(0.0), F.cos(a), F.sin(a), F.lit(0.0), -F.sin(a), F.cos(a), F.lit(0.0), g)
    target, predicted = arm(v / 100, v / 300), arm(1.1 * v / 100, v / 300 + v / 1000)
    rows = read_events(spark, sf_dir).select("user_id", F.array_repeat(predicted, 2).alias("p"), F.array_repeat(target, 2).alias("t"))
    out = episodes.arm_report(rows, "p", "t", 0.5, (1, 2), ("user_id",))
    names = ["translation", "gripper", "gripper_accuracy", "translation_at_1", "gripper_at_2"]
    # The nudge settles ties of short decimals alike here and in SQL.
    return out.select("user_id", *[F.round(F.col(n) + 1e-9, 5).alias(n) for n in names], F.round("rotation_degrees", 3).alias("rotation_degrees"))


@query("""WITH s AS (SELECT doc_id, quality, (n_chars % 1000) / 1000.0 AS p FROM labels JOIN documents USING (doc_id)),
a AS (SELECT quality, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS ry FROM s),
o AS (SELECT quality, sum(quality) OVER w / row_number() OVER w AS precision FROM s WINDOW w AS (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT least(floor(p * 10 + 1e-9), 9) AS bin, count(*) AS n, avg(p) AS c, avg(quality) AS acc FROM s GROUP BY 1)
SELECT round(avg(abs(p - quality)), 6) AS mae, round(avg((p - quality) ** 2), 6) AS mse, round(sqrt(avg((p - quality) ** 2)), 6) AS rmse, round(max(abs(p - quality)), 6) AS max_abs, sum(quality)::BIGINT AS positives, sum(1 - quality)::BIGINT AS negatives,
  round((SELECT (sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * sum(1 - quality)) FROM a), 6) AS auroc, round((SELECT avg(precision) FILTER (quality = 1) FROM o), 6) AS average_precision,
  round((SELECT corr(r, ry) FROM a), 6) AS spearman, round((SELECT sum(n * abs(c - acc)) / sum(n) FROM b), 6) AS ece FROM s""")
def value_metrics(spark, sf_dir):
    """AGG-18"""
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("p"), F.col("quality").cast("double").alias("y"))
    out = metrics.value_report(rows, "p", "y", "doc_id")
    return _rounded(out, "mae", "mse", "rmse", "max_abs", "auroc", "average_precision", "spearman", "ece")


@query("""WITH p AS (SELECT vec_id, unnest(range(64)) // 32 AS channel, round((unnest(embedding)::DOUBLE + 1) * 100) AS v FROM embeddings) SELECT channel::INTEGER AS channel, count(DISTINCT vec_id) AS n, round(avg(v / 255), 6) AS mean, round(stddev_pop(v / 255), 6) AS std FROM p GROUP BY channel""")
def image_channel_stats(spark, sf_dir):
    """AGG-07"""
    plane = lambda k: F.transform(F.slice("v", k, 32), lambda x: F.round((x + 1) * 100))
    out = stats.image_stats(_vectors(spark, sf_dir).withColumn("planes", F.array(plane(1), plane(33))), "vec_id", "planes")
    return _rounded(out, "mean", "std")


@query("""WITH p AS (SELECT a.label, unnest(range(64))::INTEGER AS position, abs(unnest(a.embedding)::DOUBLE - unnest(b.embedding)::DOUBLE) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, position, round(sum(d), 5) AS total, count(*) AS n, round(max(d), 6) AS max_abs, count(*) FILTER (d <> 0) AS different FROM p GROUP BY label, position""")
def stream_position_differences(spark, sf_dir):
    """AGG-35"""
    v = _vectors(spark, sf_dir, "label")
    rows = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    out = episodes.position_differences(rows, ["label"], "v", "w")
    return out.withColumn("total", F.round("total", 5)).withColumn("max_abs", r6(F.col("max_abs")))


@query("""WITH f AS (SELECT label FROM embeddings GROUP BY label ORDER BY min(vec_id), label LIMIT 5), p AS (SELECT unnest(range(64))::INTEGER AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE label IN (SELECT label FROM f)) SELECT channel, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM p GROUP BY channel""")
def first_episode_stats(spark, sf_dir):
    """AGG-42: a quick estimate from the first five episodes is the operator's point."""
    return _rounded(episodes.first_episode_bounds(_vectors(spark, sf_dir, "label"), "v", "label", "vec_id", 5), "mean", "std")


@query("""SELECT channel::INTEGER AS channel, CASE WHEN channel = 64 THEN ['constant'] ELSE []::VARCHAR[] END AS issues FROM range(65) t(channel)""")
def stats_contract_issues(spark, sf_dir):
    """AUD-04, AGG-05: the vector's last channel is made constant."""
    per = stats.channel_stats(_vectors(spark, sf_dir).withColumn("v", F.concat("v", F.array(F.lit(0.25)))), "v", [])
    return per.select("channel", governance.issues(governance.stats_contract("min", "max", "std")).alias("issues"))


@query(f"""WITH {LONG}, a AS (SELECT channel, avg(value) AS x FROM long GROUP BY channel), b AS (SELECT channel, avg(value) AS y FROM long WHERE label < 5 GROUP BY channel) SELECT channel, round(x, 6) AS left_value, round(y, 6) AS right_value FROM a JOIN b USING (channel) WHERE abs(x - y) > 0.002 + 0.01 * abs(y)""")
def stats_agreement(spark, sf_dir):
    """AUD-03, AUD-05"""
    v = _vectors(spark, sf_dir, "label")
    out = stats.stats_agree(stats.channel_stats(v, "v", []), stats.channel_stats(v.filter("label < 5"), "v", []), ["channel"], "mean", 0.002, 0.01)
    return _rounded(out, "left_value", "right_value")


@query("""SELECT vec_id, list_filter([CASE WHEN vec_id % 5 = 0 THEN 'v missing' END, CASE WHEN vec_id % 5 = 1 THEN 'v has wrong size' END, CASE WHEN vec_id % 5 = 2 THEN 'v not finite' END], lambda x: x IS NOT NULL) AS issues FROM embeddings""")
def vector_contract_issues(spark, sf_dir):
    """FLT-01, AUD-12, PRJ-11: faults are planted by id."""
    k = F.col("vec_id") % 5
    v = F.when(k == 1, F.slice("v", 1, 10)).when(k == 2, F.concat(F.slice("v", 1, 63), F.array(F.lit(float("nan"))))).when(k > 2, F.col("v"))
    return _vectors(spark, sf_dir).withColumn("v", v).select("vec_id", governance.issues(governance.vector_contract("v", 64)).alias("issues"))


# --- projections and steps ---------------------------------------------------------------------------------


@query("""SELECT 's/' || s_suppkey AS name, [s_acctbal::FLOAT, s_nationkey::FLOAT] AS packed, s_nationkey AS nation, 0.0::DOUBLE AS reward, false AS done FROM supplier""")
def packed_and_grouped(spark, sf_dir):
    """PRJ-02, PRJ-03, PRJ-05: scalars to a vector, columns to a struct with defaults and back to flat names."""
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s/"), "s_suppkey").alias("name"), F.col("s_acctbal").alias("observation.balance"), F.col("s_nationkey").alias("observation.nation"))
    rows = rows.withColumn("packed", tables.packed(["observation.balance", "observation.nation"]))
    flat = tables.flattened(tables.grouped(rows, "observation.", "observation", {"reward": 0.0, "done": False}))
    return flat.select("name", "packed", F.col("`observation/nation`").alias("nation"), "reward", "done")


@query("""SELECT c_custkey AS customer, c_nationkey, c_acctbal, [CASE WHEN c_nationkey > 12 THEN 9.0 ELSE c_acctbal END, 0.0, 0.0, c_nationkey::DOUBLE] AS action, [CASE WHEN c_nationkey > 12 THEN 9.0 ELSE c_acctbal END, c_nationkey::DOUBLE] AS compact FROM customer""")
def step_pipeline(spark, sf_dir):
    """PRJ-04, PRJ-09, PRJ-14, PRJ-15, PRJ-16, UDF-01, UDF-02, UDF-05: a pipeline that was saved as JSON, read again and checked by its contract."""
    load_plugins(["framegrain.plans.steps"])
    steps = [
        REGISTRY["override_action"](other="other", flag="flag"), REGISTRY["expand_action"](column="action", enabled=[0, 3], size=4),
        REGISTRY["rename"](columns={"c_custkey": "customer", "absent": "x"}), REGISTRY["drop"](columns=["other", "flag"]), REGISTRY["numeric_only"](keep=[]),
    ]
    pipeline = Pipeline.loads(Pipeline(steps).dumps())
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("action"))
    rows = rows.withColumn("other", F.array(F.lit(9.0), F.col("c_nationkey").cast("double"))).withColumn("flag", F.col("c_nationkey") > 12)
    out = pipeline(rows)
    if pipeline.contract(rows.schema, spark).names != out.columns:
        raise ValueError("the pipeline's contract does not hold")
    return REGISTRY["compact_action"](column="compact", enabled=[0, 3])(out.withColumn("compact", F.col("action")))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'top_' || p_size ELSE 'cam_a' END AS "primary", 'left_' || p_size AS "left", CASE WHEN p_size % 3 = 0 THEN 'RIGHT_CAM' END AS "right", 'hand_x' AS wrist FROM part""")
def camera_choice(spark, sf_dir):
    """PRJ-07"""
    cameras = F.array_compact(F.array(F.lit("cam_a"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("top_"), "p_size")), F.concat(F.lit("left_"), "p_size"), F.when(F.col("p_size") % 3 == 0, F.lit("RIGHT_CAM")), F.lit("hand_x")))
    return read(spark, sf_dir, "part").select("p_partkey", episodes.camera_roles(cameras).alias("c")).select("p_partkey", "c.*")


@query("""SELECT vec_id, [round(x, 6) FOR x IN list_concat(embedding[1:2], embedding[5:6])::DOUBLE[]] AS joined, [round(x, 6) FOR x IN embedding[5:6]::DOUBLE[]] AS right_arm FROM embeddings""")
def source_arrays(spark, sf_dir):
    """PRJ-10, PRJ-13, PRJ-19"""
    rows = _vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 2).alias("a"), F.slice("v", 5, 2).alias("b")).withColumn("joined", episodes.both_arms("a", "b"))
    return rows.select("vec_id", _each_signed(F.col("joined")).alias("joined"), _each_signed(episodes.per_arm("joined", 2, 1)).alias("right_arm"))


FEATURES = {"state": {"dtype": "float64", "shape": (3,)}, "camera": {"dtype": "video", "shape": (3, 4, 4)}, "grid": {"dtype": "float32", "shape": (2, 2)}, "flag": {"dtype": "bool", "shape": (1,)}}


@query("""SELECT name AS "column", kind AS type, (SELECT count(*) FROM region) AS rows, (SELECT count(*) FROM region) AS nulls FROM (VALUES ('state', 'array<double>'), ('grid', 'array<array<float>>'), ('flag', 'boolean'), ('timestamp', 'float'), ('frame_index', 'bigint'), ('episode_index', 'bigint'), ('index', 'bigint'), ('task_index', 'bigint')) t(name, kind)""")
def declared_schema(spark, sf_dir):
    """PRJ-01, PRJ-08, SRC-20: a table of a declared schema, empty in all features, and what it looks like."""
    schema = tables.schema_of(FEATURES)
    return datasets.structure(read(spark, sf_dir, "region").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]))


# --- joins, filters, sets, samples -------------------------------------------------------------------------


@query("""WITH m AS (SELECT doc_id, '/raw/' || source || '/' || lang || '/' || (doc_id // 2) || '.h5' AS path, CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE lang END AS schema_id, n_chars AS file_bytes, source, lang FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS k, CASE WHEN lang = 'fr' THEN '/other/fr' || substr(path, length('/raw/' || source || '/fr') + 1) WHEN source IN ('src1', 'src2') THEN NULL ELSE '/data/moved/' || source || substr(path, length('/raw/' || source) + 1) END AS new_path FROM m),
y AS (SELECT path || '#' || doc_id AS path, new_path || '#' || doc_id AS new_path, schema_id, file_bytes, doc_id, lang FROM x)
SELECT path, new_path, CASE WHEN new_path IS NULL THEN 'missing_covering_move' WHEN lang = 'fr' THEN 'destination_outside_input' WHEN schema_id = 'none' THEN 'schema_missing_from_catalog' WHEN doc_id % 7 = 0 THEN 'missing_file' WHEN doc_id % 7 = 1 THEN 'file_size_mismatch' END AS error FROM y WHERE error IS NOT NULL""")
def inventory_errors(spark, sf_dir):
    """JON-03: manifest, moves, catalogue and listing; what is wrong with each file."""
    docs = read(spark, sf_dir, "documents")
    rest = F.concat("lang", F.lit("/"), F.expr("doc_id div 2"), F.lit(".h5#"), "doc_id")
    manifest = docs.select(F.concat(F.lit("/raw/"), "source", F.lit("/"), rest).alias("path"), F.when(F.col("doc_id") % 11 == 0, "none").otherwise(F.col("lang")).alias("schema_id"), F.col("n_chars").alias("file_bytes"))
    by_source = docs.select("source").distinct().filter("source not in ('src1', 'src2')").select(F.concat(F.lit("/raw/"), "source").alias("source"), F.concat(F.lit("/data/moved/"), "source").alias("destination"))
    french = docs.select("source").distinct().select(F.concat(F.lit("/raw/"), "source", F.lit("/fr")).alias("source"), F.lit("/other/fr").alias("destination"))
    catalog = docs.select(F.col("lang").alias("schema_id")).distinct().withColumn("family", F.lit("arms"))
    listing = docs.filter("doc_id % 7 <> 0").select(F.concat(F.lit("/data/moved/"), "source", F.lit("/"), rest).alias("path"), (F.col("n_chars") + (F.col("doc_id") % 7 == 1).cast("long")).alias("length"))
    return joins.with_coverage(manifest, by_source.unionByName(french), catalog, listing, "/data/")[1]


@query("""SELECT doc_id, source || '/' || 'ep' || doc_id AS paired_id FROM documents""")
def paired_record_ids(spark, sf_dir):
    """JON-11: every third record names its source itself, the others by their place in the dataset's list."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", (F.row_number().over(frames.Window.partitionBy("source").orderBy("doc_id")) - 1).alias("ordinal"))
    path = F.concat(F.lit("/raw/ep"), "doc_id", F.lit("/data/trajectory.hdf5"))
    lists = docs.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ordinal", path.alias("p")))).alias("l")).select("source", F.transform("l", lambda x: x["p"]).alias("sources"))
    records = docs.select("doc_id", "source", F.col("source").alias("collection"), "ordinal", F.when(F.col("doc_id") % 3 == 0, path).otherwise(F.lit("")).alias("source_path"))
    return datasets.paired_ids(records, "ordinal", lists, "source").select("doc_id", "paired_id")


@query("""SELECT c_custkey, coalesce(arg_max(o_orderpriority, o_orderkey), 'alias ' || c_nationkey) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey""")
def latest_or_alias(spark, sf_dir):
    """JON-18"""
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("value"))
    names = read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(F.struct(F.lit(2).alias("position"), F.lit("later").alias("alias")), F.struct(F.lit(1).alias("position"), F.concat(F.lit("alias "), "c_nationkey").alias("alias")))).alias("a")).select("c_custkey", "a.*")
    return joins.latest_with_alias(log, names, "c_custkey", "o_orderkey", "value")


@query("""SELECT s_suppkey, coalesce(n_name, 'unknown') AS station, coalesce(r_name, 'unknown') AS parent FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_with_parent(spark, sf_dir):
    """JON-19: stations with their parents, unknown where there is none."""
    nations = read(spark, sf_dir, "nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("station"), "n_regionkey")
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("parent"))
    rows = joins.lookup(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nations, "s_nationkey", {"station": "unknown"})
    return joins.lookup(rows, regions, "n_regionkey", {"parent": "unknown"}).select("s_suppkey", "station", "parent")


@query("""SELECT page_id, page_id + 1 AS other FROM pages""")
def normal_path_join(spark, sf_dir):
    """JON-20: annotations name a page's path in another spelling."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("bos://Root//Dir/"), "page_id", F.lit("/")).alias("path"))
    notes = read(spark, sf_dir, "pages").select((F.col("page_id") + 1).alias("other"), F.concat(F.lit("root/dir/"), "page_id").alias("path"))
    return joins.by_normal_path(pages, notes, "path").select("page_id", "other")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand END AS expected, coalesce(p_size > 25 AND p_brand <> p_type, false) AS differs FROM part""")
def reviewed_lookup(spark, sf_dir):
    """JON-21: only reviewed rules give an expected text."""
    part = read(spark, sf_dir, "part")
    rules = part.filter("p_size > 25").select("p_partkey", F.col("p_brand").alias("expected"))
    return joins.lookup(part.select("p_partkey", "p_type"), rules, "p_partkey").select("p_partkey", "expected", F.coalesce(F.col("expected") != F.col("p_type"), F.lit(False)).alias("differs"))


@query("""SELECT page_id, page_id % 4 < 3 AND page_id % 3 <> 0 AND (page_id % 5 >= 1 OR page_id % 2 = 0) AS done FROM pages""")
def download_success(spark, sf_dir):
    """FLT-05"""
    i = F.col("page_id")
    return read(spark, sf_dir, "pages").select("page_id", datasets.succeeded(i % 4 < 3, F.when(i % 3 != 0, F.col("url")), i % 5, i % 2 == 0).alias("done"))


@query("""WITH v AS (SELECT p_brand, 'v' || (p_size % 3 + 1) || '.' || (p_partkey % 12) AS name, p_size % 3 + 1 AS a, p_partkey % 12 AS b FROM part) SELECT p_brand, arg_max(name, b) AS version FROM v WHERE a = 2 AND b <= 9 GROUP BY p_brand""")
def newest_compatible_version(spark, sf_dir):
    """FLT-14"""
    name = F.concat(F.lit("v"), F.col("p_size") % 3 + 1, F.lit("."), F.col("p_partkey") % 12)
    return datasets.compatible_version(read(spark, sf_dir, "part").select("p_brand", name.alias("name")), ["p_brand"], "name", "2.9")


@query(f"""WITH {EV} SELECT event_id, frame_index + 1 >= 40 AS at_limit FROM ev""")
def step_limit(spark, sf_dir):
    """FLT-12"""
    return frames.truncated_at(read_frames(spark, sf_dir), 40).select("event_id", "at_limit")


@query("""SELECT source, key, name FROM (SELECT 's' AS source, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 'c', c_custkey, NULL FROM customer)""")
def union_by_name(spark, sf_dir):
    """SET-02"""
    one = read(spark, sf_dir, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return sets.union_all([one, read(spark, sf_dir, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("key"))])


@query("""SELECT * FROM (VALUES ('reward'), ('task')) t(missing)""")
def missing_required_columns(spark, sf_dir):
    """SET-07"""
    return spark.createDataFrame([(c,) for c in sets.missing_columns(read_events(spark, sf_dir), ["event_id", "reward", "value", "task"])], "missing string")


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'validation' ELSE 'rest' END AS split FROM documents""")
def directory_splits(spark, sf_dir):
    """SMP-12"""
    path = F.concat(F.lit("/data/"), "lang", F.lit("/"), "doc_id", F.lit(".parquet"))
    return read(spark, sf_dir, "documents").select("doc_id", datasets.in_splits(path, {"train": "/data/en", "validation": "/data/de/"}, "rest").alias("split"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT mode, user_id, k::BIGINT AS frames, true AS inside, true AS spaced FROM n, (VALUES ('1_frame', 1), ('2_frames', 2), ('2_frames_4_space', 2), ('6_frames', 6)) t(mode, k) WHERE n > 5""")
def timestamp_modes(spark, sf_dir):
    """SMP-13: which frame is drawn is a hash; that it lies in the episode and how its group is spaced can be told."""
    lengths = read_events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for mode, offsets in sampling.TIMESTAMP_MODES.items():
        rows = sampling.timestamp_groups(lengths, "user_id", "n", mode, 10.0, 3).join(lengths, "user_id")
        want = F.array(*[F.lit(float(o - offsets[-1])) for o in offsets])
        spaced = F.forall(F.zip_with(F.transform("timestamps", lambda t: F.round(10 * (t - F.element_at("timestamps", -1)))), want, lambda a, b: a == b), lambda x: x)
        rows = rows.select(F.lit(mode).alias("mode"), "user_id", F.size("timestamps").cast("long").alias("frames"), ((F.element_at("timestamps", 1) >= 0) & (F.element_at("timestamps", -1) * 10 < F.col("n"))).alias("inside"), spaced.alias("spaced"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {EV}, g AS (SELECT row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS i, count(*) OVER () AS m FROM ev) SELECT i // (ceil(m / 7.0)::BIGINT) AS rank, count(*) AS n, min(i) AS first FROM g GROUP BY 1""")
def even_rank_shards(spark, sf_dir):
    """SMP-14"""
    rows = frames.global_index(read_frames(spark, sf_dir), "user_id")
    rows = rows.withColumn("rank", sampling.even_ranks("index", rows.count(), 7))
    return rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("first"))


@query(f"""WITH {EV}, g AS (SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS i FROM ev) SELECT event_id, i AS index FROM g WHERE i >= 100 AND i < 164""")
def sequential_batch(spark, sf_dir):
    """SMP-14: one batch of a sequence is the operator's point."""
    return sampling.index_range(frames.global_index(read_frames(spark, sf_dir), "user_id"), "index", 100, 164).select("event_id", "index")


@query("""WITH l AS (SELECT lang, row_number() OVER (ORDER BY lang) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT lang FROM documents)), r AS (SELECT lang, least(50 // m + (i <= 50 % m)::INT, 50) AS n FROM l)
SELECT 'round_robin' AS sampler, lang AS part, n::BIGINT AS n FROM r UNION ALL SELECT 'half_and_half', quality::VARCHAR, least(20, count(*)) FROM labels GROUP BY quality UNION ALL SELECT 'capped', 'all', 64""")
def sampler_counts(spark, sf_dir):
    """SMP-02, SMP-08, SMP-10: how many rows samplers take of each part; which ones is a hash."""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "lang")
    parts = {
        "round_robin": sampling.round_robin(docs, "lang", "doc_id", 50, 3).select(F.col("lang").alias("part")),
        "half_and_half": sampling.half_and_half(labels.filter("quality = 1"), labels.filter("quality = 0"), "doc_id", 40, 3).select(F.col("quality").cast("string").alias("part")),
        "capped": sampling.capped_subset(docs, "doc_id", 64, 3).select(F.lit("all").alias("part")),
    }
    return sets.union_all([rows.groupBy(F.lit(k).alias("sampler"), "part").agg(F.count(F.lit(1)).alias("n")) for k, rows in parts.items()])


# --- sources -----------------------------------------------------------------------------------------------


@query("""SELECT user_id AS episode_index, count(*) AS rows, 1::BIGINT AS files, user_id // 50 AS chunk FROM events GROUP BY user_id""")
def episode_file_rows(spark, sf_dir):
    """SRC-05, SRC-07, SNK-01, SNK-15: frames written as one file an episode, listed with their rows."""
    root = _place(spark)
    tables.write_episodes(read_frames(spark, sf_dir).withColumnRenamed("user_id", "episode_index"), root, chunk=50)
    files = tables.episode_files(spark, root)
    number = lambda n: F.regexp_extract("path", f"{n}=([0-9]+)", 1).cast("long")
    return files.groupBy(number("episode_index").alias("episode_index"), number("episode_chunk").alias("chunk")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))


@query("""SELECT user_id AS episode_index, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE user_id IN (1, 2, 3) GROUP BY user_id""")
def chosen_episodes(spark, sf_dir):
    """FLT-09: a choice of episodes prunes partitions; choosing is the operator's point."""
    root = _place(spark)
    tables.write_episodes(read_frames(spark, sf_dir).withColumnRenamed("user_id", "episode_index"), root)
    rows = tables.read_episodes(spark, root, [1, 2, 3])
    return rows.groupBy(F.col("episode_index").cast("long").alias("episode_index")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT source, count(*) AS n FROM documents GROUP BY source""")
def manifest_of_found_files(spark, sf_dir):
    """SRC-01, SRT-01: files of a name below a root, in order, then those that a manifest names."""
    root = _place(spark)
    read(spark, sf_dir, "documents").select("doc_id", "source").repartition("source").write.partitionBy("source").parquet(root)
    found = tables.find_files(spark, root, "*.parquet")
    rows = spark.read.parquet(root).groupBy("source", F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    name = lambda c: F.regexp_extract(c, "source=.*$", 0)
    manifest = tables.from_manifest(found.select(name("path").alias("path"), "length"), rows.select(name("file").alias("path")).distinct(), "source=")
    return rows.withColumn("path", name("file")).join(manifest.select("path"), "path").groupBy("source").agg(F.sum("n").alias("n"))


@query("""SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def json_lines_roundtrip(spark, sf_dir):
    """SRC-08"""
    root, nation = _place(spark), read(spark, sf_dir, "nation")
    nation.write.json(root)
    return tables.read_lines(spark, root, nation.schema, order="n_nationkey")


@query("""SELECT * FROM (SELECT 'batch_' || r_name || '/x' AS name FROM region)""")
def listing_names(spark, sf_dir):
    """SRC-10: directories in the lines of a store's listing; other lines are left out."""
    region = read(spark, sf_dir, "region")
    lines = region.select(F.concat(F.lit("      PRE batch_"), "r_name", F.lit("/x/")).alias("value")).unionByName(region.select(F.concat(F.lit("2024-01-01  12 "), "r_name").alias("value")))
    return tables.parse_listing(lines)


@query("""SELECT lang AS mode, doc_id AS global_step, metric, v AS value FROM (SELECT lang, doc_id, 'chars' AS metric, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT lang, doc_id, 'half', n_chars / 2.0 FROM documents)""")
def metric_lines(spark, sf_dir):
    """SRC-12: lines with free keys; text and booleans are no metrics."""
    root = _place(spark)
    line = F.to_json(F.struct(F.col("lang").alias("mode"), F.col("doc_id").alias("global_step"), F.col("n_chars").alias("chars"), (F.col("n_chars") / 2).alias("half"), F.lit(True).alias("ok"), F.lit("x").alias("note")))
    read(spark, sf_dir, "documents").select(line.alias("value")).write.text(root)
    return tables.read_metrics(spark, root)


@query("""SELECT p_partkey, p_name, p_retailprice, '[' || p_size || ',1]' AS sizes FROM part""")
def csv_roundtrip(spark, sf_dir):
    """SRC-13, SNK-05: nested values are written as JSON."""
    root = _place(spark)
    tables.write_csv(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", F.array("p_size", F.lit(1)).alias("sizes")), root)
    return tables.read_csv(spark, root, "p_partkey long, p_name string, p_retailprice double, sizes string")


@query("""SELECT 'e' || c_custkey AS episode_id, c_nationkey::BIGINT AS "start", c_mktsegment AS text FROM customer""")
def annotation_labels(spark, sf_dir):
    """SRC-14: of two documents that label an episode, the last file wins."""
    root = _place(spark)
    one = lambda t: F.struct(F.concat(F.lit("e"), "c_custkey").alias("episode_id"), F.array(F.struct(F.col("c_nationkey").alias("start"), F.lit(9).alias("end"), t.alias("text"))).alias("labels"))
    rows = read(spark, sf_dir, "customer").withColumn("document", F.expr("c_custkey div 200"))
    for k, value in enumerate((F.lit("old"), F.col("c_mktsegment"))):
        docs = rows.groupBy("document").agg(F.struct(F.collect_list(one(value)).alias("episodeLabels")).alias("data"))
        docs.repartition("document").write.partitionBy("document").json(f"{root}/{k}")
    return tables.annotations(spark, f"{root}/*/*").select("episode_id", F.get("labels", F.lit(0)).alias("l")).select("episode_id", "l.start", "l.text")


@query("""SELECT o_orderstatus AS run, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def run_summaries(spark, sf_dir):
    """SRC-25: one JSON document a run, read with its path."""
    root = _place(spark)
    read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).repartition("o_orderstatus").write.partitionBy("o_orderstatus").json(root)
    rows = tables.read_document(spark, root, "n long, o_orderstatus string")
    return rows.select(F.regexp_extract("path", "o_orderstatus=([A-Z])", 1).alias("run"), "n")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'review' ELSE o_orderstatus END AS quality_status FROM orders""")
def migrated_records(spark, sf_dir):
    """SRC-26: half of the records have the status under its old name only."""
    new = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "review").otherwise(F.col("o_orderstatus"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, new).alias("quality_status"), F.col("o_orderstatus").alias("status"))
    return tables.typed_records(rows, {"F": "passed", "O": "review"})


@query("""SELECT n_nationkey::BIGINT + 3 AS line, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END AS region FROM nation""")
def board_records(spark, sf_dir):
    """SRC-09: a board with a title, a header in another order and case, and an empty line."""
    nation = read(spark, sf_dir, "nation")
    body = nation.select((F.col("n_nationkey") + 3).cast("long").alias("line"), F.array(F.lit("x"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string")).otherwise(F.lit(" ")), F.concat(F.lit(" "), "n_name")).alias("cells"))
    head = spark.createDataFrame([(0, ["Board of tasks"]), (1, ["Note", " REGION ", "Task Name"]), (2, ["", " ", ""])], "line long, cells array<string>")
    return datasets.located_columns(body.unionByName(head), "line", "cells", {"name": "task name", "region": "Region"})


def _files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 2 == 0, F.lit("/data/trajectory.hdf5")).otherwise(F.lit("/trajectory.hdf5"))
    return docs.select("doc_id", "lang", F.concat(F.lit("/raw/"), "source", F.lit("/ep"), "doc_id", tail).alias("path"), F.col("n_chars").alias("length"))


@query("""SELECT lang AS root, source AS collection, 'ep' || doc_id AS episode_id, n_chars AS length FROM documents WHERE doc_id % 10 <> 0 AND source <> 'src3'""")
def listed_sources(spark, sf_dir):
    """SRC-11, SRC-24, UDF-06: a lister that is passed in, episodes and whole ids that are excluded, and no source twice."""
    files = _files(spark, sf_dir)
    roots = [r["lang"] for r in files.select("lang").distinct().orderBy("lang").collect()]  # one row a root
    found = datasets.listed(spark, roots, lambda s, root: files.filter(F.col("lang") == root))
    docs = read(spark, sf_dir, "documents")
    gone = docs.filter("doc_id % 10 = 0").select(F.concat(F.lit("ep"), "doc_id").alias("id")).unionByName(docs.filter("source = 'src3'").select(F.concat(F.lit("src3/ep"), "doc_id").alias("id")))
    rows = datasets.sources(found, F.get(F.split("path", "/"), F.lit(2)), gone)
    return rows.join(found.select("path", "root"), "path").select("root", "collection", "episode_id", "length")


@query("""SELECT source AS task, count(*) FILTER (n_chars >= 400) AS files, coalesce(sum(n_chars) FILTER (n_chars >= 400), 0)::BIGINT AS bytes, count(*) FILTER (n_chars < 400) AS corrupt FROM documents GROUP BY source""")
def task_file_groups(spark, sf_dir):
    """SRC-22: files that can't be read are counted apart."""
    files = _files(spark, sf_dir).withColumn("error", F.when(F.col("length") < 400, "truncated"))
    # Half of the files lie one folder deeper.
    deeper = F.size(F.split("path", "/")) == 6
    return datasets.task_groups(files.filter(deeper), 3).unionByName(datasets.task_groups(files.filter(~deeper), 2)).groupBy("task").agg(*[F.sum(c).alias(c) for c in ("files", "bytes", "corrupt")])


@query("""SELECT s_suppkey, CASE s_nationkey % 4 WHEN 0 THEN 'dual' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'single' END AS layout FROM supplier""")
def robot_layouts(spark, sf_dir):
    """SRC-23"""
    k = F.col("s_nationkey") % 4
    fields = F.array_compact(F.array(F.lit("obs/pose"), F.when(k < 2, F.lit("arm/Left/pose")), F.when((k == 0) | (k == 2), F.lit("arm_right.gripper"))))
    return read(spark, sf_dir, "supplier").select("s_suppkey", datasets.robot_layout(fields).alias("layout"))


# --- sinks and finished datasets ---------------------------------------------------------------------------


@query(f"""WITH {EV}, t AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS task_index FROM ev GROUP BY event_type) SELECT event_id, frame_index, round(frame_index / 10.0, 6) AS timestamp, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS index, task_index FROM ev JOIN t USING (event_type)""")
def buffered_frames(spark, sf_dir):
    """SNK-02: what a frame gets when it joins a dataset."""
    rows = frames.global_index(read_frames(spark, sf_dir), "user_id")
    codes = frames.first_seen_codes(rows, "event_type", "event_id").select("event_type", F.col("code").alias("task_index"))
    return joins.lookup(rows, codes, "event_type").select("event_id", "frame_index", F.round(F.col("frame_index") / 10.0, 6).alias("timestamp"), "index", "task_index")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS episodes, sum(n)::BIGINT AS frames, min(n) AS shortest, max(n) AS longest, (SELECT count(DISTINCT event_type) FROM events) AS tasks, sum(n) / 10.0 AS seconds FROM n""")
def dataset_metadata(spark, sf_dir):
    """SNK-17, SNK-03"""
    return datasets.dataset_info(read_events(spark, sf_dir), "user_id", "event_type", 10.0)


@query("""SELECT user_id, count(*) AS length, list(DISTINCT event_type ORDER BY event_type) AS tasks FROM events GROUP BY user_id""")
def episode_metadata(spark, sf_dir):
    """SNK-03, SNK-17"""
    return datasets.episode_lines(read_events(spark, sf_dir), "user_id", "event_type")


@query("""WITH p AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k FROM events GROUP BY user_id), l AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, user_id || '|' || n || '|' || k || chr(10) AS l FROM p),
a AS (SELECT i // 64 AS i, sha256(string_agg(l, '' ORDER BY i)) AS l FROM l GROUP BY i // 64), b AS (SELECT i // 64 AS i, sha256(string_agg(l, '' ORDER BY i)) AS l FROM a GROUP BY i // 64), c AS (SELECT sha256(string_agg(l, '' ORDER BY i)) AS l FROM b)
SELECT (SELECT count(*) FROM l) AS rows, CASE WHEN (SELECT count(*) FROM a) = 1 THEN (SELECT max(l) FROM a) WHEN (SELECT count(*) FROM b) = 1 THEN (SELECT max(l) FROM b) ELSE (SELECT l FROM c) END AS sha256""")
def stats_sidecar(spark, sf_dir):
    """SNK-08, AUD-03: a tree of hashes over a table of statistics."""
    per = read_events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("k"))
    return datasets.digest(per, ["user_id"], ["user_id", "n", "k"], fan=64)


@query("""SELECT count(*) AS rows, true AS refused, count(*) + 1 AS replaced FROM nation""")
def frozen_manifest(spark, sf_dir):
    """SNK-16: a second save is refused, an asked-for one replaces."""
    path, nation = _place(spark), read(spark, sf_dir, "nation")
    datasets.save_manifest(nation, path)
    try:
        datasets.save_manifest(nation, path)
        refused = False
    except AnalysisException as e:
        refused = e.getCondition() == "PATH_ALREADY_EXISTS"
    first = spark.read.parquet(path).count()
    datasets.save_manifest(nation.unionByName(nation.limit(1)), path, overwrite=True)
    return spark.read.parquet(path).agg(F.lit(first).cast("long").alias("rows"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("replaced"))


@query("""SELECT user_id, count(*) FILTER (event_type <> 'click') AS n, round(sum(value) FILTER (event_type <> 'click'), 4) AS total FROM events WHERE user_id % 2 = 0 GROUP BY user_id HAVING count(*) FILTER (event_type <> 'click') > 0
UNION ALL SELECT user_id, count(*), round(sum(value), 4) FROM events WHERE user_id % 2 = 1 GROUP BY user_id""")
def episode_transactions(spark, sf_dir):
    """SNK-07: all episodes are written, even ones again; a run that breaks off leaves the version before it in sight."""
    root = _place(spark)
    events = read_events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    again = events.filter("user_id % 2 = 0 AND event_type <> 'click'")
    first = versions.commit(events, root, "user_id")

    def broken():
        raise RuntimeError("stopped before the commit")

    try:
        versions.commit(again, root, "user_id", fail=broken)
    except RuntimeError:
        if versions.snapshot(spark, root).count() != events.count():
            raise ValueError("what was not committed is seen, or what was is not") from None
    versions.commit(again, root, "user_id", expected=first)
    # Even users whose events are clicks only keep their first version, as their episode was not written again.
    rows = versions.snapshot(spark, root).join(events.filter("event_type <> 'click' OR user_id % 2 = 1").select("user_id").distinct(), "user_id", "left_semi")
    return rows.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT version, user_id, n FROM (SELECT 1 AS version, user_id, count(*) AS n FROM events GROUP BY user_id
UNION ALL SELECT 2, user_id, count(*) FILTER (event_type <> 'error') FROM events WHERE user_id % 3 = 0 GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') > 0
UNION ALL SELECT 2, user_id, count(*) FROM events GROUP BY user_id HAVING user_id % 3 <> 0 OR count(*) FILTER (event_type <> 'error') = 0) t""")
def episode_versions(spark, sf_dir):
    """SNK-07: both versions of a dataset, each as a reader of that version sees it."""
    root = _place(spark)
    events = read_events(spark, sf_dir).select("event_id", "user_id", "event_type")
    for part in (events, events.filter("user_id % 3 = 0 AND event_type <> 'error'")):
        versions.commit(part, root, "user_id")
    counts = [versions.snapshot(spark, root, v).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "user_id", "n") for v in (1, 2)]
    return counts[0].unionByName(counts[1])


@query("""SELECT run, count(*) AS records, count(DISTINCT o_orderkey) AS orders FROM (SELECT 'planned' AS run, o_orderkey FROM orders UNION ALL SELECT 'status-' || o_orderstatus, o_orderkey FROM orders) t GROUP BY run""")
def journal_runs(spark, sf_dir):
    """SNK-06, SNK-09: runs appended through a data source that writes, each of them twice; no record is there twice."""
    path, orders = _place(spark), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for run in ["planned", *(f"status-{s}" for s in ("F", "O", "P"))] * 2:
        rows = orders if run == "planned" else orders.filter(F.col("o_orderstatus") == run[-1])
        journal.append_run(rows.withColumn("run", F.lit(run)), path, run)
    return journal.read_runs(spark, path, "o_orderkey long, run string").groupBy("run").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("o_orderkey").alias("orders"))


@query("""SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus""")
def appended_journal(spark, sf_dir):
    """SNK-06, SNK-18: a journal in which every record is planned first, then gets its status; the latest row of each counts."""
    path, orders = _place(spark), read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    tables.append_journal(orders.withColumn("step", F.lit(0)), path, "planned")
    for status in ("F", "O", "P"):
        tables.append_journal(orders.filter(F.col("o_orderstatus") == status).withColumn("step", F.lit(1)), path, status)
    return governance.status_counts(tables.read_lines(spark, path, "o_orderkey long, step int, status string"), "o_orderkey", "step", "status")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey > 10 THEN 'done' ELSE 'open' END AS status, s_name AS name, CASE WHEN s_nationkey > 10 THEN s_acctbal END AS bytes FROM supplier""")
def merged_status_document(spark, sf_dir):
    """SNK-18"""
    rows = read(spark, sf_dir, "supplier")
    old = rows.select("s_suppkey", F.lit("open").alias("status"), F.col("s_name").alias("name"))
    return datasets.merged_status(old, rows.filter("s_nationkey > 10").select("s_suppkey", F.lit("done").alias("status"), F.col("s_acctbal").alias("bytes")), "s_suppkey")


@query("""SELECT event_id, round(value, 4) AS a FROM events WHERE event_type = 'error'""")
def intervention_rows(spark, sf_dir):
    """SNK-09: intervention frames whose vectors are checked while they are written."""
    root = _place(spark)
    rows = read_events(spark, sf_dir).select("event_id", "event_type", F.array("value", F.lit(1.0)).alias("v"))
    datasets.checked_rows(rows, F.col("event_type") == "error", {"v": 2}).write.parquet(root)
    return spark.read.parquet(root).select("event_id", F.round(F.get("v", F.lit(0)), 4).alias("a"))


@query("""WITH d AS (SELECT user_id, event_id, coalesce(sum((event_type = 'error')::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode_index FROM events) SELECT user_id, event_id, episode_index::BIGINT AS episode_index FROM d""")
def ring_export(spark, sf_dir):
    """SNK-10"""
    rows = read_events(spark, sf_dir).withColumn("done", F.col("event_type") == "error")
    return tables.export_order(rows, "event_id", "done", "user_id").select("user_id", "event_id", "episode_index")


@query("""SELECT event_type AS metric, arg_max(value, event_id) AS value FROM events GROUP BY event_type""")
def metric_gauges(spark, sf_dir):
    """SNK-13"""
    rows = read_events(spark, sf_dir).select(F.col("event_type").alias("metric"), F.col("event_id").alias("global_step"), "value")
    nan = rows.select("metric", (F.col("global_step") + 10**9).alias("global_step"), F.lit(float("nan")).alias("value"))
    return tables.latest_gauges(rows.unionByName(nan))


@query("""SELECT 0 AS line, '| key | name | n |' AS text UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL
SELECT 1 + row_number() OVER (ORDER BY c_custkey), '| ' || c_custkey || ' | ' || c_name || ' | ' || coalesce(n::VARCHAR, '') || ' |' FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def markdown_report(spark, sf_dir):
    """SNK-14: a report of any length, line by line, read back from the file that was written."""
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    rows = read(spark, sf_dir, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "n")
    path = _place(spark)
    tables.write_markdown(rows, ["key"], path)
    lines = tables.markdown_lines(rows, ["key"])
    there = spark.read.text(path).select(F.col("value").alias("text"))
    return lines.join(there, "text", "left_semi")


@query("""SELECT source AS schema_id, lang AS family, count(*) AS files, list(DISTINCT n_chars % 3 ORDER BY n_chars % 3) AS stations, count(DISTINCT n_chars % 50) AS tasks, count(*) FILTER (n_chars > 2000) AS passed, min(doc_id) AS representative FROM documents GROUP BY lang, source""")
def schema_file_catalog(spark, sf_dir):
    """AGG-23, SRT-03, SRC-04"""
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("family"), F.col("source").alias("schema_id"), (F.col("n_chars") % 3).alias("station"), (F.col("n_chars") % 50).alias("task"), F.when(F.col("n_chars") > 2000, "passed").otherwise("review").alias("status"), "doc_id")
    return governance.schema_catalog(rows, "schema_id", "family", "station", "task", "status", "doc_id")


@query("""SELECT lang AS family, count(DISTINCT source) AS schemas, count(*) AS files, list(DISTINCT n_chars % 3 ORDER BY n_chars % 3) AS stations FROM documents GROUP BY lang""")
def schema_family_rollup(spark, sf_dir):
    """AGG-23"""
    return governance.family_rollup(schema_file_catalog(spark, sf_dir), "family")


@query("""SELECT kind, next_episode::BIGINT AS next_episode, issue FROM (SELECT 'whole' AS kind, count(DISTINCT user_id) AS next_episode, NULL AS issue FROM events UNION ALL SELECT 'gap', 2, 'gap' UNION ALL SELECT 'changed', count(DISTINCT user_id), 'fingerprint changed' FROM events)""")
def resume_points(spark, sf_dir):
    """STM-10, AUD-11"""
    users = frames.episode_bounds(read_events(spark, sf_dir), "user_id").select("dense_index", F.lit("f1").alias("fingerprint"))
    cases = {"whole": (users, "f1"), "gap": (users.filter("dense_index <> 2"), "f1"), "changed": (users, "f2")}
    return sets.union_all([datasets.resume_point(rows, "dense_index", "fingerprint", now).withColumn("kind", F.lit(k)) for k, (rows, now) in cases.items()])


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 3 <> 0 THEN 'planned' WHEN page_id % 2 <> 0 AND page_id % 3 = 0 THEN 'moved' WHEN page_id % 6 = 0 THEN 'conflict' ELSE 'lost' END AS state FROM pages""")
def interrupted_moves(spark, sf_dir):
    """STM-13"""
    return read(spark, sf_dir, "pages").select("page_id", governance.recovered(F.col("page_id") % 2 == 0, F.col("page_id") % 3 == 0).alias("state"))
