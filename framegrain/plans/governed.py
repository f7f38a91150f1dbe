"""Queries of governance, sets, sampling, geometry and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegrain.functions import geometry, text
from framegrain.operators import frames, governance, joins, sampling, sets
from framegrain.plans.registry import EV, ORDER, query, r6, read, read_events, read_frames

# --- inventories -------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT r_name, n_name, o_orderstatus, o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS v, length(o_orderpriority)::BIGINT AS b FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, n_name, o_orderstatus, grouping_id(r_name, n_name, o_orderstatus)::BIGINT AS grouping_id, count(*) AS files, count(DISTINCT o_custkey) AS episodes, round(sum(v), 2) AS total, min(v) AS shortest, max(v) AS longest, round(avg(v), 4) AS average, sum((v IS NULL)::BIGINT)::BIGINT AS missing, sum(b)::BIGINT AS bytes
FROM o GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (o_orderstatus), (r_name, o_orderstatus), ())""")
def inventory_rollup_grouping_sets(spark, sf_dir):
    """AGG-01, AGG-02"""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.select("r_name", "n_name", "o_orderstatus", "o_custkey", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("v"), F.length("o_orderpriority").cast("long").alias("b"))
    out = governance.grouping_sets(rows, [["r_name"], ["r_name", "n_name"], ["o_orderstatus"], ["r_name", "o_orderstatus"], []], governance.inventory("v", "o_custkey", "b"))
    return out.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 4)).withColumn("grouping_id", F.col("grouping_id").cast("long"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) SELECT lang, arg_max(source, (n, source)) AS baseline, max(n) AS n FROM c GROUP BY lang""")
def baseline_argmax(spark, sf_dir):
    """AGG-24"""
    return governance.baseline(read(spark, sf_dir, "documents"), "lang", "source")


@query("""WITH s AS (SELECT lang, source, list(DISTINCT doc_id % 17) AS g FROM documents GROUP BY lang, source), c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source), b AS (SELECT lang, arg_max(source, (n, source)) AS baseline FROM c GROUP BY lang)
SELECT s.lang, s.source, list_sort(list_filter(s.g, lambda x: NOT list_contains(r.g, x))) AS added, list_sort(list_filter(r.g, lambda x: NOT list_contains(s.g, x))) AS missing FROM s JOIN b USING (lang) JOIN s r ON r.lang = s.lang AND r.source = b.baseline""")
def schema_signal_changes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    schemas = docs.groupBy("lang", "source").agg(F.collect_set(F.col("doc_id") % 17).alias("signals"))
    return governance.signal_changes(schemas, governance.baseline(docs, "lang", "source"), "lang", "source", "signals")


def _with_repeats(spark, sf_dir):
    """documents with `repeated`: whether another row has the text. Digests that occur twice are joined, not all texts."""
    docs = read(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    twice = governance.duplicates(docs, ["sha"], "doc_id").select("sha", F.lit(True).alias("repeated"))
    return docs.join(twice, "sha", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))


RANKS = {"too short": "warning", "too long": "review", "repeated text": "quarantine"}


@query("""WITH i AS (SELECT doc_id, lang, source, list_filter([CASE WHEN n_chars < 300 THEN 'too short' END, CASE WHEN n_chars > 9000 THEN 'too long' END, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'repeated text' END], lambda x: x IS NOT NULL) AS issues FROM documents)
SELECT doc_id, issues, CASE WHEN list_contains(issues, 'repeated text') THEN 'quarantine' WHEN list_contains(issues, 'too long') THEN 'review' WHEN list_contains(issues, 'too short') THEN 'warning' ELSE 'passed' END AS status FROM i""")
def issue_list(spark, sf_dir):
    found = governance.issues({"too short": F.col("n_chars") < 300, "too long": F.col("n_chars") > 9000, "repeated text": F.col("repeated")})
    rows = _with_repeats(spark, sf_dir).select("doc_id", found.alias("issues"))
    return rows.withColumn("status", governance.severity(F.col("issues"), RANKS))


@query("""WITH s AS (SELECT source, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN 3 WHEN n_chars > 9000 THEN 2 WHEN n_chars < 300 THEN 1 ELSE 0 END AS k FROM documents) SELECT source, ['passed', 'warning', 'review', 'quarantine'][max(k) + 1] AS status, count(*) AS n FROM s GROUP BY source""")
def severity_rollup(spark, sf_dir):
    """AGG-22"""
    found = governance.issues({"too short": F.col("n_chars") < 300, "too long": F.col("n_chars") > 9000, "repeated text": F.col("repeated")})
    rows = _with_repeats(spark, sf_dir).select("source", governance.severity(found, RANKS).alias("status"))
    return governance.worst_by_group(rows, ["source"], "status")


@query("""SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_detection(spark, sf_dir):
    """AGG-29"""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return governance.duplicates(rows, ["sha"], "doc_id")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS first FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return governance.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey")


@query("""SELECT count(DISTINCT event_type) = 1 AS event_type, count(DISTINCT length(props) > 0) = 1 AS has_props FROM events""")
def homogeneity_audit(spark, sf_dir):
    """AUD-02"""
    return governance.homogeneous(read_events(spark, sf_dir).select("event_type", (F.length("props") > 0).alias("has_props")), ["event_type", "has_props"])


@query("""WITH f AS (SELECT source AS batch, doc_id // 4 AS episode, lang AS schema_id, CASE WHEN n_chars < 200 THEN 'bad' ELSE 'good' END AS bucket, doc_id % 97 <> 0 AS movable FROM documents),
b AS (SELECT batch, count(DISTINCT schema_id) = 1 AND count(DISTINCT bucket) = 1 AND bool_and(movable) AS whole FROM f GROUP BY batch),
e AS (SELECT batch, episode, count(DISTINCT schema_id) = 1 AND count(DISTINCT bucket) = 1 AND bool_and(movable) AS whole, count(*) AS files FROM f JOIN b USING (batch) WHERE NOT b.whole GROUP BY batch, episode)
SELECT 'batch' AS unit, batch, NULL AS episode, count(*) AS files FROM f JOIN b USING (batch) WHERE b.whole GROUP BY batch UNION ALL SELECT CASE WHEN whole THEN 'episode' ELSE 'conflict' END, batch, episode::VARCHAR, files FROM e""")
def move_plan(spark, sf_dir):
    """AUD-07"""
    files = read(spark, sf_dir, "documents").select(
        F.col("source").alias("batch"), F.expr("doc_id div 4").alias("episode"), F.col("lang").alias("schema_id"), F.when(F.col("n_chars") < 200, "bad").otherwise("good").alias("bucket"), (F.col("doc_id") % 97 != 0).alias("movable")
    )
    plan, conflicts = governance.move_plan(files, "batch", "episode", "schema_id", "bucket", "movable")
    conflicts = conflicts.select(F.lit("conflict").alias("unit"), "batch", F.col("episode").cast("string").alias("episode"), "files")
    return plan.select("unit", "batch", "episode", "files").unionByName(conflicts)


@query("""WITH p AS (SELECT user_id, count(*) AS files, sum(length(props))::BIGINT AS bytes FROM events GROUP BY user_id), q AS (SELECT user_id, count(*) AS files, sum(length(props))::BIGINT AS bytes FROM events WHERE value >= 1 GROUP BY user_id)
SELECT user_id, list_filter([CASE WHEN p.files IS DISTINCT FROM q.files THEN 'files' END, CASE WHEN p.bytes IS DISTINCT FROM q.bytes THEN 'bytes' END], lambda x: x IS NOT NULL) AS differs, CASE WHEN p.files IS DISTINCT FROM q.files OR p.bytes IS DISTINCT FROM q.bytes THEN 'failed' ELSE 'verified' END AS status FROM p LEFT JOIN q USING (user_id)""")
def verify_destination(spark, sf_dir):
    """AUD-06"""
    total = lambda d: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("props")).alias("bytes"))
    events = read_events(spark, sf_dir)
    return governance.verified(total(events), total(events.filter("value >= 1")), "user_id", ["files", "bytes"])


@query("""WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE n_chars >= 300), b AS (SELECT doc_id, lang, n_chars + n_chars % 2 AS n_chars FROM documents WHERE n_chars <= 3000)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_left' WHEN a.doc_id IS NULL THEN 'only_right' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.n_chars <> b.n_chars""")
def changed_records(spark, sf_dir):
    """SET-04, AUD-09"""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    right = docs.filter("n_chars <= 3000").withColumn("n_chars", F.col("n_chars") + F.col("n_chars") % 2)
    return governance.changed(docs.filter("n_chars >= 300"), right, "doc_id", ["lang", "n_chars"])


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN upper(lang) ELSE lang END AS l2, CASE WHEN doc_id % 25 = 0 THEN n_chars + 1 ELSE n_chars END AS n2, lang, n_chars FROM documents) SELECT doc_id, list_filter([CASE WHEN lang <> l2 THEN 'lang' END, CASE WHEN n_chars <> n2 THEN 'n_chars' END], lambda x: x IS NOT NULL) AS fields FROM b WHERE lang <> l2 OR n_chars <> n2""")
def differing_fields(spark, sf_dir):
    """AUD-10, AUD-13"""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 9 == 0, F.upper("lang")).otherwise(F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") % 25 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return governance.differing_fields(docs, other, "doc_id", ["lang", "n_chars"])


@query("""WITH k AS (SELECT doc_id AS i FROM documents WHERE n_chars >= 300 UNION ALL SELECT doc_id FROM documents WHERE n_chars > 3000), c AS (SELECT i, count(*) AS n FROM k GROUP BY i), d AS (SELECT i, n, lead(i) OVER (ORDER BY i) AS nx FROM c)
SELECT i, n, CASE WHEN n > 1 THEN 'duplicate' ELSE 'gap after' END AS problem FROM d WHERE n > 1 OR nx > i + 1""")
def index_contiguity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), "n_chars")
    return governance.index_gaps(docs.filter("n_chars >= 300").select("i").unionByName(docs.filter("n_chars > 3000").select("i")), "i")


@query("""WITH j AS (SELECT user_id % 40 AS item, event_id AS seq, CASE event_type WHEN 'click' THEN 'moving' WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'failed' ELSE 'moved' END AS status FROM events), l AS (SELECT item, arg_max(status, seq) AS status FROM j GROUP BY item) SELECT status, count(*) AS n FROM l GROUP BY status""")
def journal_status(spark, sf_dir):
    return governance.status_counts(_journal(spark, sf_dir), "item", "seq", "status")


@query("""WITH j AS (SELECT user_id % 40 AS item, event_id AS seq, CASE event_type WHEN 'click' THEN 'moving' WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'failed' ELSE 'moved' END AS status FROM events), p AS (SELECT item, seq, lag(status) OVER (PARTITION BY item ORDER BY seq) AS before, status FROM j)
SELECT * FROM p WHERE before IS NOT NULL AND before || '>' || status NOT IN ('planned>moving', 'moving>moved', 'moving>failed', 'moved>verified', 'moved>failed', 'failed>moving')""")
def journal_illegal_transitions(spark, sf_dir):
    """STM-09"""
    return governance.illegal_transitions(_journal(spark, sf_dir), "item", "seq", "status")


def _journal(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "click", "moving").when(kind == "purchase", "verified").when(kind == "error", "failed").otherwise("moved")
    return read_events(spark, sf_dir).select((F.col("user_id") % 40).alias("item"), F.col("event_id").alias("seq"), status.alias("status"))


# --- sets --------------------------------------------------------------------------------------------------


@query("""SELECT 0 AS dataset_index, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark""")
def union_common_columns(spark, sf_dir):
    """SET-01"""
    docs = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return sets.union_common([docs, read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id")])


@query("""WITH a AS (SELECT DISTINCT user_id AS id FROM events), b AS (SELECT c_custkey AS id FROM customer) SELECT id, 'missing' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT id, 'extra' FROM (FROM b EXCEPT FROM a)""")
def missing_and_extra(spark, sf_dir):
    """SET-05, SET-06"""
    a = read_events(spark, sf_dir).select(F.col("user_id").alias("id")).distinct()
    return sets.missing_and_extra(a, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


@query("""SELECT x AS step FROM (SELECT DISTINCT doc_id // 10 AS x FROM labels INTERSECT SELECT DISTINCT doc_id // 10 FROM documents WHERE n_chars > 3000) UNION SELECT DISTINCT 0 FROM documents WHERE doc_id // 10 = 0 AND n_chars > 3000""")
def common_steps(spark, sf_dir):
    """FLT-13"""
    step = F.expr("doc_id div 10").alias("step")
    return sets.common_steps(read(spark, sf_dir, "labels").select(step), read(spark, sf_dir, "documents").filter("n_chars > 3000").select(step), "step")


# --- sampling ----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), r AS (SELECT lang, n, 1 AS a, 1 AS b, 1 AS c FROM c UNION ALL SELECT lang, n, a + (k = 0)::INTEGER, b + (k = 1)::INTEGER, c + (k = 2)::INTEGER
FROM (SELECT *, CASE WHEN x >= y AND x >= z THEN 0 WHEN y >= z THEN 1 ELSE 2 END AS k FROM (SELECT *, 0.8::DOUBLE * n - a AS x, 0.1::DOUBLE * n - b AS y, 0.1::DOUBLE * n - c AS z FROM r WHERE a + b + c < n)))
SELECT lang, unnest(['train', 'val', 'test']) AS split, unnest([a, b, c])::BIGINT AS n FROM r WHERE a + b + c = n""")
def stratified_split_counts(spark, sf_dir):
    """SMP-01"""
    docs = read(spark, sf_dir, "documents")
    out = sampling.stratified_split(docs, "lang", "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}, 7)
    return out.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'train' AS split, round_even(n * 0.9, 0)::BIGINT AS n FROM n UNION ALL SELECT 'test', n - round_even(n * 0.9, 0)::BIGINT FROM n""")
def ratio_split_counts(spark, sf_dir):
    """SMP-03"""
    return sampling.ratio_split(read(spark, sf_dir, "documents"), "doc_id", 0.9, 7).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, e AS (SELECT event_id, user_id % 2 = 0 AS online, user_id % 2 <> 0 OR n - 1 - frame_index >= 2 AS ok FROM ev), k AS (SELECT online, sum(ok::BIGINT) AS k FROM e GROUP BY online)
SELECT event_id, round(CASE WHEN ok THEN CASE WHEN online THEN 0.8 ELSE 0.2 END / k ELSE 0 END * 1e6, 6) AS weight FROM e JOIN k USING (online)""")
def sampler_weights(spark, sf_dir):
    """SMP-05"""
    rows = read_events(spark, sf_dir).withColumn("online", F.col("user_id") % 2 == 0)
    out = sampling.frame_weights(rows, "online", "user_id", ORDER, 0.8, drop_last=2)
    return out.select("event_id", r6(F.col("weight") * 1e6).alias("weight"))


@query("""SELECT event_id, value, event_id % 256 AS slot FROM events ORDER BY event_id DESC LIMIT 256""")
def fifo_newest_n(spark, sf_dir):
    """SRT-04"""
    return sampling.newest(read_events(spark, sf_dir), "event_id", 256).select("event_id", "value", "slot")


@query("""SELECT 1::INTEGER AS quality, 80::BIGINT AS n UNION ALL SELECT 0, 20""")
def label_balanced_sample(spark, sf_dir):
    """SMP-04"""
    out = sampling.label_balanced(read(spark, sf_dir, "labels"), "quality", "doc_id", 100, 0.8, 11)
    return out.groupBy(F.col("quality").cast("int").alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, g AS (SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS i, count(*) OVER () AS m FROM ev) SELECT event_id, i % 8 AS shard, CASE WHEN i < (m % 8) * (m // 8 + 1) THEN i // (m // 8 + 1) ELSE m % 8 + (i - (m % 8) * (m // 8 + 1)) // (m // 8) END AS rank FROM g""")
def world_shards(spark, sf_dir):
    """SMP-07"""
    rows = frames.global_index(read_frames(spark, sf_dir), "user_id")
    return rows.select("event_id", sampling.shard_of("index", 8).alias("shard"), sampling.rank_ranges("index", rows.count(), 8).alias("rank"))


@query(f"""WITH {EV}, b AS (SELECT user_id, count(*) AS n FROM ev GROUP BY user_id) SELECT DISTINCT user_id, floor(f * (n - 1))::BIGINT AS "row" FROM b, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) t(f)""")
def fractional_rows(spark, sf_dir):
    """SMP-15"""
    lengths = read_events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return sampling.fractional_rows(lengths, "user_id", "n", [0, 0.25, 0.5, 0.75, 1])


@query(f"""WITH {EV}, b AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT user_id FROM ev)) SELECT i AS episode, 1000 // m + (i < 1000 % m)::BIGINT AS n FROM b""")
def quota_per_episode(spark, sf_dir):
    """SMP-06"""
    bounds = frames.episode_bounds(read_events(spark, sf_dir), "user_id")
    taken = sampling.episode_quota(bounds, "dense_index", "length", 1000, 4, 3).groupBy("episode").agg(F.count("row").alias("n"))
    # With more episodes than samples, later ones have none.
    return bounds.select(F.col("dense_index").alias("episode")).join(taken, "episode", "left").select("episode", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT count(*) AS n, min(batch) AS first_batch, max(slot) AS last_slot FROM (SELECT unnest(range(0, 2 * greatest(ceil(a / 16.0), ceil(b / 16.0))::BIGINT)) AS batch, 15::BIGINT AS slot FROM (SELECT count(*) FILTER (quality = 0) AS a, count(*) FILTER (quality = 1) AS b FROM labels)), range(16)""")
def alternating_batches(spark, sf_dir):
    """SMP-09"""
    labels = read(spark, sf_dir, "labels")
    dense = lambda v: frames.first_seen_codes(labels.filter(F.col("quality") == v), "doc_id", "doc_id").select("doc_id", "code")
    out = sampling.alternating(dense(0), dense(1), "code", 16)
    return out.agg(F.count(F.lit(1)).alias("n"), F.min("batch").alias("first_batch"), F.max("slot").alias("last_slot"))


@query("""WITH d AS (SELECT doc_id, lang, ('0x' || substr(md5('3:' || doc_id), 1, 15))::BIGINT AS h, ('0x' || substr(md5('5:' || doc_id), 1, 15))::BIGINT AS o FROM documents), l AS (SELECT doc_id, quality, ('0x' || substr(md5((4 - quality) || ':' || doc_id), 1, 15))::BIGINT AS h FROM labels)
SELECT 'round_robin' AS sampler, doc_id FROM (SELECT doc_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY h DESC, doc_id DESC) AS r FROM d) ORDER BY r, lang LIMIT 50)
UNION ALL SELECT 'half_and_half', doc_id FROM l WHERE quality IN (0, 1) QUALIFY row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) <= 20
UNION ALL SELECT 'capped', doc_id FROM (SELECT doc_id FROM d ORDER BY h, doc_id LIMIT 64) UNION ALL SELECT 'objective', doc_id FROM d WHERE o % (1 << 30) / (1 << 30)::DOUBLE < 0.3""")
def random_samplers(spark, sf_dir):
    """SMP-11"""
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    parts = {
        "round_robin": sampling.round_robin(docs, "lang", "doc_id", 50, 3).select("doc_id"),
        "half_and_half": sampling.half_and_half(labels.filter("quality = 1"), labels.filter("quality = 0"), "doc_id", 40, 3).select("doc_id"),
        "capped": sampling.capped_subset(docs, "doc_id", 64, 3).select("doc_id"),
        "objective": docs.filter(sampling.objectives("doc_id", {"a": 0.3, "b": 0.7}, 5) == "a").select("doc_id"),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("sampler"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- geometry ----------------------------------------------------------------------------------------------


def _quaternions(spark, sf_dir):
    q = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    p = F.transform(F.slice("embedding", 5, 3), lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", q.alias("q"), p.alias("p"))


@query("""SELECT vec_id, true AS matrix_ok, true AS quaternion_ok, true AS euler_ok FROM embeddings""")
def rotation6d_roundtrip(spark, sf_dir):
    """MTH-01, MTH-02, MTH-03"""
    rows = _quaternions(spark, sf_dir).withColumn("m", geometry.quaternion_to_matrix(F.col("q"))).withColumn("u", geometry.unit(F.col("q")))
    near = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))) < 1e-9
    return rows.select(
        "vec_id", near(geometry.six_to_matrix(geometry.matrix_to_six(F.col("m"))), F.col("m")).alias("matrix_ok"),
        (geometry.quaternion_distance(geometry.matrix_to_quaternion(F.col("m")), F.col("u")) < 1e-9).alias("quaternion_ok"),
        near(geometry.euler_to_matrix(geometry.matrix_to_euler(F.col("m"))), F.col("m")).alias("euler_ok"),
    )


@query("""WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings), u AS (SELECT vec_id, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM q)),
p AS (SELECT a.vec_id, least(1.0, abs(a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w)) AS d FROM u a JOIN u b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(degrees(2 * acos(d)), 3) AS angle FROM p""")
def rotation_angle_between(spark, sf_dir):
    """MTH-09"""
    rows = _quaternions(spark, sf_dir).select("vec_id", geometry.quaternion_to_matrix(F.col("q")).alias("m"))
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("other"))
    return rows.join(nxt, "vec_id").select("vec_id", F.round(geometry.angle_between(F.col("m"), F.col("other")), 3).alias("angle"))


@query("""SELECT a.vec_id, true AS pose_ok, true AS action_ok FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def action_encode_decode(spark, sf_dir):
    """MTH-05, MTH-06"""
    rows = _quaternions(spark, sf_dir).select("vec_id", "p", geometry.quaternion_to_matrix(F.col("q")).alias("m"))
    nxt = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("p1"), F.col("m").alias("m1"))
    rows = rows.join(nxt, "vec_id").withColumn("d", geometry.local_delta(F.col("p"), F.col("m"), F.col("p1"), F.col("m1")))
    action = geometry.encode_action(F.col("d"), F.lit(0.25), 100.0, 3.2, 1.0, six=True)
    rows = rows.withColumn("back", geometry.decode_action(action, 100.0, 3.2, 1.0, six=True)).withColumn("to", geometry.advanced(F.col("p"), F.col("m"), F.col("d")))
    near = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))) < 1e-9
    return rows.select("vec_id", (near("to.position", "p1") & near("to.rotation", "m1")).alias("pose_ok"), (near("back.translation", "d.translation") & near("back.rotation", "d.rotation")).alias("action_ok"))


# --- text --------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/+', '/', 'g'), '/') AS bare, url FROM pages), s AS (SELECT *, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g') AS j FROM u)
SELECT page_id, split_part(bare, '/', 1) AS store, CASE WHEN contains(bare, '/') THEN substr(bare, strpos(bare, '/') + 1) ELSE '' END AS path, split_part(bare, '/', -1) AS leaf, coalesce(nullif(regexp_replace(j, '^[._]+|[._]+$', '', 'g'), ''), 'unnamed') AS slug FROM s""")
def slug_and_uri_normalize(spark, sf_dir):
    """STR-02, STR-03"""
    return read(spark, sf_dir, "pages").select("page_id", text.uri_parts(F.col("url")).alias("u"), text.slug(F.col("url")).alias("slug")).select("page_id", "u.*", "slug")


@query("""SELECT doc_id, left(sha256(doc_id::VARCHAR || chr(0) || source || chr(0) || lang), 16) AS record_id FROM documents""")
def record_id_sha256(spark, sf_dir):
    """STR-11"""
    return read(spark, sf_dir, "documents").select("doc_id", text.record_id(F.col("doc_id"), F.col("source"), F.col("lang")).alias("record_id"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, NULL::DOUBLE AS other FROM events""")
def json_props_extract(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    return read_events(spark, sf_dir).select("event_id", text.number_at(props, "k").alias("k"), text.number_at(props, "other").alias("other"))


@query("""SELECT doc_id, CASE WHEN n_chars * 1000 >= 1048576 THEN printf('%.2f MiB', n_chars * 1000 / 1048576.0) WHEN n_chars * 1000 >= 1024 THEN printf('%.2f KiB', n_chars * 1000 / 1024.0) ELSE printf('%d B', n_chars * 1000) END AS size FROM documents""")
def iec_sizes(spark, sf_dir):
    """STR-08"""
    return read(spark, sf_dir, "documents").select("doc_id", text.byte_size(F.col("n_chars") * 1000).alias("size"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'steel|brass') THEN 'metal' WHEN regexp_matches(lower(p_type), 'promo') THEN 'offer' ELSE 'unknown' END AS kind FROM part""")
def keyword_classes(spark, sf_dir):
    """STR-09"""
    return read(spark, sf_dir, "part").select("p_partkey", text.classified(F.col("p_type"), {"metal": ["steel", "brass"], "offer": ["promo"]}).alias("kind"))


@query("""SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-01-01' AS recent, strftime(o_orderdate, '%m%d') || '_am_' || lower(o_orderstatus) AS collection FROM orders""")
def dated_names(spark, sf_dir):
    """FLT-03"""
    # Names carry dates of this century, so the orders' dates move on by ten years.
    name = F.concat(F.lit("batch_20101301_"), F.date_format(F.add_months("o_orderdate", 120), "yyyyMMdd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.dated_from(name, "20080101").alias("recent"), text.collection_name(F.col("o_orderdate"), F.lit("AM"), F.col("o_orderstatus")).alias("collection"))
