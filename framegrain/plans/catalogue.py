"""All queries: frames, joins, statistics and metrics here; governance, sampling and functions, streams beside."""

from __future__ import annotations

from pyspark.sql import functions as F

from framegrain.operators import frames, joins, metrics, stats
from framegrain.plans.registry import EV, ORACLES, ORDER, QUERIES, query
from framegrain.plans.registry import r6 as _r
from framegrain.plans.registry import read as _read
from framegrain.plans.registry import read_events as _events
from framegrain.plans.registry import read_frames as _frames

__all__ = ["ORACLES", "QUERIES"]

# --- episodes and windows ----------------------------------------------------------------------------------


@query(f"""WITH {EV} SELECT event_id, user_id, frame_index,
  list(value) OVER c || list_transform(range(16 - least(16, n - frame_index)), lambda i: last_value(value) OVER a) AS chunk,
  (16 - least(16, n - frame_index))::INTEGER AS is_pad_count,
  coalesce(lead(value, 16) OVER o, last_value(value) OVER a) AS future_value, round(sum(value) OVER g, 6) AS return_to_go
FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING),
  a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), g AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def chunk_future_return(spark, sf_dir):
    """WIN-01, WIN-02, WIN-05"""
    return _frames(spark, sf_dir).select(
        "event_id", "user_id", "frame_index", frames.forward_chunk("value", 16, "user_id", ORDER).alias("chunk"), frames.chunk_padding(16, "user_id", ORDER).alias("is_pad_count"),
        frames.future_value("value", 16, "user_id", ORDER).alias("future_value"), _r(frames.return_to_go("value", "user_id", ORDER)).alias("return_to_go"),
    )


@query(f"""WITH {EV}, b AS (SELECT user_id, count(*) AS length FROM ev GROUP BY user_id),
c AS (SELECT user_id, length, sum(length) OVER (ORDER BY user_id)::BIGINT AS to_index, row_number() OVER (ORDER BY user_id) - 1 AS dense_index FROM b)
SELECT user_id, length, to_index - length AS from_index, to_index, dense_index FROM c""")
def episode_index_offsets(spark, sf_dir):
    """WIN-08"""
    return frames.episode_bounds(_events(spark, sf_dir), "user_id")


@query(f"""WITH {EV} SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS global_index, dense_rank() OVER (ORDER BY user_id) - 1 AS dense_index FROM ev""")
def global_reindex(spark, sf_dir):
    """WIN-11"""
    return frames.global_index(_frames(spark, sf_dir), "user_id").select("event_id", F.col("index").alias("global_index"), "dense_index")


@query(f"""WITH {EV}, g AS (SELECT *, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS i FROM ev) SELECT row_number() OVER (ORDER BY min(i)) - 1 AS run, user_id, min(i) AS from_index, max(i) + 1 AS to_index FROM g GROUP BY user_id""")
def bounds_by_change(spark, sf_dir):
    return frames.bounds_by_change(frames.global_index(_frames(spark, sf_dir), "user_id"), "index", "user_id").withColumn("run", F.col("run").cast("long"))


@query(f"""WITH {EV} SELECT event_id, [coalesce(lag(value, 3) OVER o, first_value(value) OVER a), value, coalesce(lead(value, 5) OVER o, last_value(value) OVER a)] AS value_at,
  [frame_index < 3, false, frame_index + 5 >= n] AS value_is_pad
FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def offset_join_with_pad(spark, sf_dir):
    """JON-08, WIN-18"""
    offsets = frames.seconds_to_offsets([-0.3, 0.0, 0.5], 10.0, 1e-4)
    return frames.relative_values(_events(spark, sf_dir), "value", offsets, "user_id", ORDER).select("event_id", "value_at", "value_is_pad")


@query(f"""WITH {EV} SELECT event_id, CASE WHEN user_id % 3 <> 0 AND n - frame_index <= 5 THEN 10.0 ELSE -0.05 END::DOUBLE AS reward, user_id % 3 <> 0 AND n - frame_index <= 5 AS done FROM ev""")
def success_tail_reward(spark, sf_dir):
    """WIN-06"""
    reward, done = frames.success_tail(F.col("user_id") % 3 != 0, 5, "user_id", ORDER)
    return _events(spark, sf_dir).select("event_id", reward.alias("reward"), done.alias("done"))


@query(f"""WITH {EV}, p AS (SELECT a.event_id, round(sum(b.value * power(0.97, b.frame_index - a.frame_index)) + 1e-9, 4) AS discounted_return FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.frame_index >= a.frame_index GROUP BY a.event_id) SELECT * FROM p""")
def discounted_return(spark, sf_dir):
    # Values of two decimals make ties in the fifth place common; the nudge settles them alike here and in SQL.
    out = frames.discounted_returns(_events(spark, sf_dir), "value", 0.97, "user_id", ORDER)
    return out.select("event_id", _r(F.col("discounted_return") + 1e-9, 4).alias("discounted_return"))


@query(f"""WITH {EV} SELECT event_id, round(2 * power(0.99, n - 1 - frame_index) - 1, 6) AS scaled_return FROM ev""")
def terminal_return(spark, sf_dir):
    """WIN-04"""
    return _events(spark, sf_dir).select("event_id", _r(frames.terminal_return(F.lit(1.0), 0.99, "user_id", ORDER)).alias("scaled_return"))


@query(f"""WITH {EV} SELECT event_id, coalesce(lead(value) OVER o, value) AS next_value, frame_index = n - 1 AS done, frame_index = n - 1 AS truncated FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def next_state_transitions(spark, sf_dir):
    """JON-15"""
    return frames.next_states(_events(spark, sf_dir), ["value"], "user_id", ORDER).select("event_id", "next_value", "done", "truncated")


@query(f"""WITH {EV} SELECT event_id, coalesce(lead(value) OVER o, value) AS next_value, frame_index = n - 1 AS done, false AS truncated, CASE WHEN frame_index = n - 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def demonstration_transitions(spark, sf_dir):
    """SRC-21, JON-16"""
    return joins.transitions_with_reward(_events(spark, sf_dir), "user_id", ORDER, "value").select("event_id", "next_value", "done", "truncated", "reward")


@query(f"""WITH {EV} SELECT event_id, user_id, frame_index FROM ev WHERE frame_index >= 2 AND frame_index < n - 3""")
def drop_edge_frames(spark, sf_dir):
    """FLT-06"""
    return frames.drop_edge_frames(_frames(spark, sf_dir), "user_id", ORDER, 2, 3).select("event_id", "user_id", "frame_index")


@query(f"""WITH {EV}, g AS (SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM ev) SELECT event_id, round(gap, 6) AS gap FROM g WHERE abs(gap - 3600) > 1800""")
def timestamp_gap_audit(spark, sf_dir):
    """WIN-09"""
    rows = _events(spark, sf_dir).withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return frames.timestamp_gaps(rows, "seconds", 1 / 3600.0, 1800.0, "user_id", ORDER).select("event_id", _r(F.col("gap")).alias("gap"))


@query(f"""WITH {EV}, m AS (SELECT user_id, n, CASE WHEN value > lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN frame_index END AS i FROM ev) SELECT user_id, max(n) - 1 - coalesce(max(i), 0) AS stall FROM m GROUP BY user_id""")
def trailing_stall(spark, sf_dir):
    """WIN-10"""
    return frames.trailing_stall(_events(spark, sf_dir), "value", "user_id", ORDER)


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type""")
def latest_record_dedupe(spark, sf_dir):
    """WIN-12"""
    rows = _events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value")
    return frames.latest_record(rows, ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id", "value")


@query("""SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def forward_fill(spark, sf_dir):
    """WIN-13"""
    rows = _events(spark, sf_dir).withColumn("sparse", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    return rows.select("event_id", frames.forward_fill("sparse", "user_id", ORDER).alias("filled"))


@query("""SELECT source, min(doc_id) AS first_seen, row_number() OVER (ORDER BY min(doc_id), source) AS code FROM documents GROUP BY source""")
def first_seen_vocab(spark, sf_dir):
    """WIN-15"""
    return frames.first_seen_codes(_read(spark, sf_dir, "documents"), "source", "doc_id", reserve=1)


@query(f"""WITH {EV}, k AS (SELECT user_id, max(n) AS n FROM ev GROUP BY user_id), i AS (SELECT DISTINCT user_id, round_even(u * (n - 1) / 9.0, 0)::BIGINT AS frame_index FROM k, range(10) t(u)) SELECT event_id, frame_index FROM ev JOIN i USING (user_id, frame_index)""")
def even_sampling(spark, sf_dir):
    """WIN-16"""
    return frames.evenly_spaced(_events(spark, sf_dir), "user_id", ORDER, F.lit(10).cast("long")).select("event_id", "frame_index")


@query("""SELECT event_id, coalesce((value - lag(value) OVER w) / 0.5, 0) AS velocity, CASE WHEN (value < 10 AND lag(value) OVER w > 40) OR (value > 40 AND lag(value) OVER w < 10) THEN -0.1 ELSE 0.0 END::DOUBLE AS penalty FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_velocity_penalty(spark, sf_dir):
    """WIN-23, WIN-24"""
    return _events(spark, sf_dir).select("event_id", frames.velocity("value", 0.5, "user_id", ORDER).alias("velocity"), frames.flip_penalty("value", "value", "user_id", ORDER, 10.0, 40.0, -0.1).alias("penalty"))


@query("""WITH d AS (SELECT user_id, event_id, ts, value, coalesce(sum((event_type = 'error')::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM events)
SELECT user_id, part::BIGINT AS part, count(*) AS frames, round(sum(value), 6) AS total FROM d GROUP BY user_id, part""")
def split_by_done(spark, sf_dir):
    """WIN-14"""
    rows = _events(spark, sf_dir).withColumn("done", F.col("event_type") == "error")
    rows = rows.withColumn("part", frames.finished_episodes("done", ORDER, "user_id"))
    return rows.groupBy("user_id", "part").agg(F.count(F.lit(1)).alias("frames"), _r(F.sum("value")).alias("total"))


@query("""WITH r AS (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id), t AS (SELECT quantile_cont(total, 0.8) AS cut FROM r)
SELECT e.user_id, round(r.total, 6) AS total, count(*) AS frames FROM events e JOIN r USING (user_id), t WHERE r.total >= t.cut GROUP BY e.user_id, r.total""")
def top_return_episodes(spark, sf_dir):
    """FLT-07"""
    events = _events(spark, sf_dir)
    returns = events.groupBy("user_id").agg(F.sum("value").alias("total"))
    cut = returns.agg(F.percentile("total", 0.8).alias("cut"))
    best = returns.crossJoin(F.broadcast(cut)).filter("total >= cut")
    return events.join(best, "user_id").groupBy("user_id", "total").agg(F.count(F.lit(1)).alias("frames")).withColumn("total", _r(F.col("total")))


@query(f"""WITH {EV}, x AS (SELECT max(user_id) AS top FROM ev) SELECT event_id, user_id + top + 1 AS user_id FROM ev, x""")
def resumed_index(spark, sf_dir):
    """WIN-19, WIN-20"""
    events = _events(spark, sf_dir)
    return frames.resumed(events.select("event_id", "user_id"), events, "user_id")


# --- joins -------------------------------------------------------------------------------------------------


@query(f"""WITH {EV}, f AS (SELECT user_id, epoch_us(ts) AS t, event_id, value FROM ev WHERE frame_index % 2 = 0), q AS (SELECT user_id, epoch_us(ts) AS asked_at, event_id AS query_id FROM ev WHERE frame_index % 2 = 1),
p AS (SELECT q.user_id, q.asked_at, q.query_id, f.t AS bt, f.value AS bv FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.asked_at >= f.t),
x AS (SELECT p.*, f.t AS at_, f.value AS av FROM p ASOF LEFT JOIN f ON p.user_id = f.user_id AND p.asked_at <= f.t)
SELECT user_id, asked_at, query_id, CASE WHEN at_ IS NULL OR asked_at - bt <= at_ - asked_at THEN bv ELSE av END AS value, CASE WHEN at_ IS NULL OR asked_at - bt <= at_ - asked_at THEN asked_at - bt ELSE at_ - asked_at END AS distance,
  CASE WHEN at_ IS NULL OR asked_at - bt <= at_ - asked_at THEN asked_at - bt ELSE at_ - asked_at END > 3600000000 AS is_pad FROM x""")
def asof_nearest_tolerance(spark, sf_dir):
    """JON-07"""
    rows = _frames(spark, sf_dir).withColumn("asked_at", F.unix_micros(F.col("ts").cast("timestamp")))
    known = rows.filter("frame_index % 2 = 0").select("user_id", F.col("asked_at").alias("t"), "value")
    asked = rows.filter("frame_index % 2 = 1").select("user_id", "asked_at", F.col("event_id").alias("query_id"))
    return joins.nearest_asof(asked, known, "user_id", "asked_at", "t", "value", 3_600_000_000)


@query(f"""WITH {EV}, l AS (SELECT user_id, k * 12 AS s, k * 12 + 17 AS e, k AS ordinal, 'part' || k AS label FROM (SELECT DISTINCT user_id FROM ev), range(4) t(k))
SELECT ev.event_id, arg_max(label, ordinal) AS label, round(arg_max((frame_index - s) / greatest(e - s, 1), ordinal), 6) AS progress, coalesce(bool_or(frame_index = s), false) AS is_start, coalesce(bool_or(frame_index = e), false) AS is_end
FROM ev LEFT JOIN l ON ev.user_id = l.user_id AND frame_index BETWEEN s AND e GROUP BY ev.event_id""")
def interval_label_join(spark, sf_dir):
    """JON-06"""
    rows = _frames(spark, sf_dir).select("event_id", "user_id", "frame_index")
    k = F.explode(F.sequence(F.lit(0), F.lit(3)))
    labels = rows.select("user_id").distinct().withColumn("ordinal", k).select("user_id", (F.col("ordinal") * 12).alias("start_pos"), (F.col("ordinal") * 12 + 17).alias("end_pos"), "ordinal", F.concat(F.lit("part"), "ordinal").alias("label"))
    return joins.interval_labels(rows, labels, "user_id", "frame_index").select("event_id", "label", _r(F.col("progress")).alias("progress"), "is_start", "is_end")


@query("""SELECT o_orderkey, c_mktsegment, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def task_lookup_join(spark, sf_dir):
    """JON-01"""
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    return joins.lookup(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey").drop("o_custkey")


PATTERNS = [("steel", "metal"), ("brass", "metal"), ("small", "size"), ("promo", "offer")]


@query("""WITH p(pattern, kind) AS (VALUES ('steel', 'metal'), ('brass', 'metal'), ('small', 'size'), ('promo', 'offer')), m AS (SELECT p_type, count(pattern) AS matches, any_value(kind) AS k FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN p ON contains(lower(p_type), pattern) GROUP BY p_type)
SELECT p_partkey, matches, CASE WHEN matches = 1 THEN k ELSE 'unclear' END AS kind FROM part JOIN m USING (p_type)""")
def pattern_theta_join(spark, sf_dir):
    """JON-04"""
    patterns = spark.createDataFrame(PATTERNS, "pattern string, kind string")
    return joins.single_pattern_join(_read(spark, sf_dir, "part").select("p_partkey", "p_type"), patterns, "p_type", "pattern", "kind", "unclear").drop("p_type")


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '^[a-zA-Z]+://', '') AS path FROM pages), p AS (SELECT DISTINCT split_part(path, '/', 1) AS prefix, 1 AS d FROM u UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2 FROM u WHERE path LIKE '%/en/%')
SELECT page_id, arg_max(prefix, d) AS covering, max(d)::INTEGER AS depth FROM u JOIN p ON path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id""")
def prefix_ancestor_join(spark, sf_dir):
    """JON-02"""
    rows = _read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-zA-Z]+://", "").alias("path"))
    parts = F.split("path", "/")
    one = rows.select(F.get(parts, F.lit(0)).alias("prefix"))
    two = rows.filter("path like '%/en/%'").select(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("prefix"))
    names = one.unionByName(two).distinct().withColumn("covering", F.col("prefix"))
    return joins.longest_prefix_join(rows, names, "path", "prefix", "covering").select("page_id", "covering", "depth")


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_anti_join(spark, sf_dir):
    """JON-05"""
    return joins.missing(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


@query("""WITH k AS (SELECT doc_id AS id, 'l' AS c FROM documents UNION SELECT doc_id, 'm' FROM labels UNION SELECT item_id, 'r' FROM benchmark), b AS (SELECT id, string_agg(c, '' ORDER BY c) AS bucket FROM k GROUP BY id) SELECT bucket, count(*) AS n FROM b GROUP BY bucket""")
def set_buckets(spark, sf_dir):
    """SET-03"""
    ids = lambda t, c: _read(spark, sf_dir, t).select(F.col(c).alias("id"))
    return joins.difference_buckets(ids("documents", "doc_id"), ids("labels", "doc_id"), ids("benchmark", "item_id"), "id").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EV}, b AS (SELECT user_id, count(*) AS length, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS m FROM ev GROUP BY user_id), p AS (SELECT *, CASE WHEN (i + greatest(1, m // 2)) % m = i THEN (i + 1) % m ELSE (i + greatest(1, m // 2)) % m END AS partner FROM b)
SELECT event_id, p.partner, q.user_id AS partner_user, frame_index % q.length AS partner_row FROM ev JOIN p USING (user_id) JOIN b q ON q.i = p.partner""")
def partner_shuffle_join(spark, sf_dir):
    """JON-12"""
    rows = _frames(spark, sf_dir)
    bounds = frames.episode_bounds(rows, "user_id")
    pairs = joins.partners(bounds.select("user_id", "dense_index", "length"), "dense_index", "length")
    names = bounds.select(F.col("dense_index").alias("partner"), F.col("user_id").alias("partner_user"))
    return rows.join(pairs.join(names, "partner").select("user_id", "partner", "partner_user", "partner_rows"), "user_id").select("event_id", "partner", "partner_user", (F.col("frame_index") % F.col("partner_rows")).alias("partner_row"))


@query("""WITH l AS (SELECT l_returnflag AS run, unnest(['quantity', 'price', 'discount']) AS metric, unnest([avg(l_quantity), avg(l_extendedprice), avg(l_discount)]) AS v FROM lineitem GROUP BY l_returnflag)
SELECT metric, round(max(CASE WHEN run = 'A' THEN v END), 6) AS a, round(max(CASE WHEN run = 'N' THEN v END), 6) AS n, round(max(CASE WHEN run = 'R' THEN v END), 6) AS r FROM l GROUP BY metric""")
def summary_pivot_compare(spark, sf_dir):
    """JON-13"""
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.lower("l_returnflag").alias("run")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    long = rows.unpivot("run", ["quantity", "price", "discount"], "metric", "v")
    return joins.compare_runs(long, "metric", "run", "v", ["a", "n", "r"]).select("metric", *[_r(F.col(c)).alias(c) for c in "anr"])


@query("""WITH b AS (SELECT l_suppkey AS k, count(*) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), a AS (SELECT s_suppkey AS k, s_nationkey::BIGINT AS c FROM supplier) SELECT coalesce(a.k, b.k) AS k, a.c AS left_rows, b.c AS right_rows,
CASE WHEN b.k IS NULL THEN 'only left' WHEN a.k IS NULL THEN 'only right' WHEN a.c <> b.c THEN 'row counts differ' END AS issue FROM a FULL JOIN b ON a.k = b.k""")
def paired_encodings(spark, sf_dir):
    """JON-09"""
    left = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("rows"))
    right = _read(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    return joins.paired(left, right, "k", "rows")


@query("""SELECT d.doc_id, coalesce(l.quality, d.doc_id % 2)::INTEGER AS quality FROM (SELECT doc_id FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def overlay_missing(spark, sf_dir):
    """JON-14"""
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    other = docs.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    return joins.overlay(docs.join(labels, "doc_id", "left"), other, "doc_id", ["quality"]).withColumn("quality", F.col("quality").cast("int"))


@query("""SELECT u.position, d.doc_id, d.source FROM (VALUES (0, 7), (1, 3), (2, 100), (3, 42)) u(position, doc_id) JOIN documents d USING (doc_id)""")
def requested_rows(spark, sf_dir):
    """SRC-06, JON-17"""
    return joins.in_request_order(_read(spark, sf_dir, "documents"), [7, 3, 100, 42], "doc_id").select("position", "doc_id", "source")


# --- statistics --------------------------------------------------------------------------------------------

LONG = "long AS (SELECT vec_id, label, unnest(range(64))::INTEGER AS channel, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"""WITH {LONG} SELECT label, channel, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM long GROUP BY label, channel""")
def vector_channel_stats(spark, sf_dir):
    """AGG-03, AGG-08"""
    out = stats.channel_stats(_read(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return out.select("label", "channel", "n", "min", "max", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


@query(f"""WITH {LONG} SELECT channel, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM long GROUP BY channel""")
def merged_channel_stats(spark, sf_dir):
    """AGG-04"""
    parts = stats.channel_stats(_read(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return stats.merged_stats(parts, []).select("channel", "n", "min", "max", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


def _bounds(df, keys=()):
    per = stats.channel_stats(df, "embedding", list(keys))
    return stats.vector_of(per, list(keys), "min").crossJoin(stats.vector_of(per, list(keys), "max")) if not keys else per


@query(f"""WITH {LONG}, s AS (SELECT channel, min(value) AS a, max(value) AS b FROM long GROUP BY channel), z AS (SELECT vec_id, channel, 2 * ((value - a) / (b - a)) - 1 AS x, value, a, b FROM long JOIN s USING (channel))
SELECT vec_id, round(sum(x), 5) AS total, round(max(abs(x)), 6) AS widest, max(abs(0.5 * (x + 1) * (b - a) + a - value)) < 1e-9 AS exact FROM z GROUP BY vec_id""")
def minmax_normalize_roundtrip(spark, sf_dir):
    """MTH-10, MTH-12"""
    vectors = _read(spark, sf_dir, "embeddings")
    rows = vectors.crossJoin(F.broadcast(_bounds(vectors)))
    rows = rows.withColumn("x", stats.scale_minmax("embedding", F.col("min"), F.col("max"))).withColumn("back", stats.unscale_minmax("x", F.col("min"), F.col("max")))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    error = F.array_max(F.zip_with("back", "embedding", lambda a, b: F.abs(a - b)))
    return rows.select("vec_id", _r(total, 5).alias("total"), _r(F.array_max(F.transform("x", F.abs))).alias("widest"), (error < 1e-9).alias("exact"))


@query(f"""WITH {LONG}, s AS (SELECT channel, min(value) AS a, max(value) AS b FROM long WHERE label < 5 GROUP BY channel)
SELECT vec_id, sum((value < a - 1e-6)::BIGINT)::BIGINT AS below, sum((value > b + 1e-6)::BIGINT)::BIGINT AS above, coalesce(list(DISTINCT channel ORDER BY channel) FILTER (value < a - 1e-6 OR value > b + 1e-6), []) AS channels FROM long JOIN s USING (channel) GROUP BY vec_id""")
def out_of_range_report(spark, sf_dir):
    """AGG-06"""
    vectors = _read(spark, sf_dir, "embeddings")
    return stats.out_of_range(vectors, "embedding", ["vec_id"], stats.channel_stats(vectors.filter("label < 5"), "embedding", []))


@query("""WITH v AS (SELECT vec_id, list_filter([i for i in range(len(embedding))], lambda i: embedding[i + 1] < -0.15 OR embedding[i + 1] > 0.15) AS bad FROM embeddings) SELECT vec_id, [x::INTEGER for x in bad] AS violated, len(bad) > 0 AS any_violation FROM v""")
def bounds_violation(spark, sf_dir):
    """FLT-11"""
    bad = F.array_compact(F.transform("embedding", lambda x, i: F.when((x < F.lit(-0.15).cast("float")) | (x > F.lit(0.15).cast("float")), i)))  # at the vectors' own precision
    return _read(spark, sf_dir, "embeddings").select("vec_id", bad.alias("violated"), (F.size(bad) > 0).alias("any_violation"))


@query("""SELECT round(greatest(quantile_cont(abs(l_discount), 0.99), 0.001), 6) AS l_discount, round(greatest(quantile_cont(abs(l_tax), 0.99), 0.001), 6) AS l_tax FROM lineitem""")
def delta_scales(spark, sf_dir):
    """AGG-09"""
    out = stats.delta_scale(_read(spark, sf_dir, "lineitem"), {"l_discount": 1e-3, "l_tax": 1e-3})
    return out.select(*[_r(F.col(c)).alias(c) for c in out.columns])


@query("""SELECT l_linestatus, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) AS weighted_discount, round(sum(CASE WHEN l_tax > 0.04 THEN l_discount ELSE 0 END) / greatest(sum((l_tax > 0.04)::DOUBLE), 1), 6) AS masked_discount FROM lineitem GROUP BY l_linestatus""")
def weighted_masked_means(spark, sf_dir):
    """AGG-10, AGG-20, AGG-38"""
    return _read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(_r(stats.weighted_mean("l_discount", "l_quantity")).alias("weighted_discount"), _r(metrics.masked_mean(F.col("l_discount"), F.col("l_tax") > 0.04)).alias("masked_discount"))


# --- metrics -----------------------------------------------------------------------------------------------

SCORED = "s AS (SELECT doc_id, quality, toxic, n_chars::DOUBLE AS n_chars, (n_chars % 1000) / 1000.0 AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf_dir):
    rows = _read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents"), "doc_id")
    return rows.select("doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("n_chars"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"))


@query(f"""WITH {SCORED}, r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM s)
SELECT sum(quality)::BIGINT AS positives, sum(1 - quality)::BIGINT AS negatives, round((sum(r) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * sum(1 - quality)), 6) AS auroc FROM r""")
def auroc(spark, sf_dir):
    """AGG-14"""
    return metrics.auroc(_scored(spark, sf_dir), "n_chars", "quality").withColumn("auroc", _r(F.col("auroc")))


@query(f"""WITH {SCORED}, r AS (SELECT quality, sum(quality) OVER w / row_number() OVER w AS p FROM s WINDOW w AS (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)) SELECT sum(quality)::BIGINT AS positives, round(avg(p) FILTER (quality = 1), 6) AS average_precision FROM r""")
def average_precision(spark, sf_dir):
    """AGG-15, WIN-22"""
    return metrics.average_precision(_scored(spark, sf_dir), "n_chars", "quality", "doc_id").withColumn("average_precision", _r(F.col("average_precision")))


@query(f"""WITH {SCORED}, r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM s) SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r""")
def spearman(spark, sf_dir):
    """AGG-16"""
    return metrics.spearman(_scored(spark, sf_dir), "n_chars", "score").withColumn("spearman", _r(F.col("spearman")))


@query(f"""WITH {SCORED}, b AS (SELECT least(floor(score * 10 + 1e-12), 9) AS bin, count(*) AS n, avg(score) AS c, avg(quality) AS a FROM s GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b""")
def calibration_error(spark, sf_dir):
    """AGG-17"""
    return metrics.calibration_error(_scored(spark, sf_dir), "score", "quality").withColumn("ece", _r(F.col("ece")))


@query("""SELECT l_returnflag, round(avg(abs(l_discount - l_tax)), 6) AS mae, round(avg((l_discount - l_tax) * (l_discount - l_tax)), 6) AS mse, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 6) AS rmse, round(max(abs(l_discount - l_tax)), 6) AS max_abs FROM lineitem GROUP BY l_returnflag""")
def regression_metrics(spark, sf_dir):
    """AGG-13"""
    out = _read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*metrics.regression_errors(F.col("l_discount"), F.col("l_tax")))
    return out.select("l_returnflag", *[_r(F.col(c)).alias(c) for c in out.columns[1:]])


@query("""SELECT user_id, round(sum(value), 6) AS reward, bool_or(event_type = 'error') AS any_flag, round(avg((event_type = 'error')::DOUBLE), 6) AS flag_rate, count(*) AS steps FROM events GROUP BY user_id""")
def episode_outcome_rates(spark, sf_dir):
    """AGG-37"""
    out = metrics.outcome_rates(_events(spark, sf_dir), "user_id", "value", F.col("event_type") == "error")
    return out.withColumn("reward", _r(F.col("reward"))).withColumn("flag_rate", _r(F.col("flag_rate")))


@query("""WITH m AS (SELECT event_type, user_id, avg(value) AS v FROM events GROUP BY event_type, user_id) SELECT event_type, count(*) AS episodes, round(avg(v), 6) AS mean FROM m GROUP BY event_type""")
def two_level_mean(spark, sf_dir):
    return metrics.episode_means(_events(spark, sf_dir), "user_id", "value", ["event_type"]).withColumn("mean", _r(F.col("mean")))


@query(f"""WITH m AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY event_type, user_id), h AS (SELECT user_id, d, md5('42:' || user_id || ':' || d) AS h FROM (SELECT DISTINCT user_id FROM events), range(500) t(d)),
w AS (SELECT user_id, 4 * d + k AS r, len(list_filter({list(metrics.POISSON)}, lambda p: p <= ('0x' || substr(h, 7 * k + 1, 7))::BIGINT / 268435456.0)) AS n FROM h, range(4) t(k)),
b AS (SELECT event_type, r, sum(n * m) / sum(n) AS v FROM m JOIN w USING (user_id) GROUP BY event_type, r HAVING sum(n) > 0), q AS (SELECT event_type, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM b GROUP BY event_type)
SELECT event_type, count(*) AS episodes, round(avg(m), 6) AS mean, round(quantile_disc(m, 0.5), 6) AS median, round(stddev_pop(m), 6) AS std, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM m JOIN q USING (event_type) GROUP BY event_type""")
def bootstrap_ci(spark, sf_dir):
    """AGG-12"""
    out = metrics.bootstrap_interval(_events(spark, sf_dir), "user_id", "value", ["event_type"])
    return out.select("event_type", "episodes", *[_r(F.col(c)).alias(c) for c in ("mean", "median", "std", "low", "high")])


@query(f"""WITH {EV}, d AS (SELECT user_id, min(frame_index) FILTER (event_type = 'error') AS d FROM ev GROUP BY user_id)
SELECT user_id, round(sum(value), 6) AS sum_reward, max(value) AS max_reward, bool_or(event_type = 'purchase') AS success FROM ev JOIN d USING (user_id) WHERE d IS NULL OR frame_index <= d + 1 GROUP BY user_id""")
def rollout_summary(spark, sf_dir):
    """AGG-26"""
    rows = _frames(spark, sf_dir).withColumn("done", F.col("event_type") == "error").withColumn("ok", F.col("event_type") == "purchase")
    return metrics.rollouts(rows, "user_id", "frame_index", "value", "done", "ok").withColumn("sum_reward", _r(F.col("sum_reward")))


@query("""WITH r AS (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id) SELECT user_id, round(total * 1000 / (max(total) OVER () - min(total) OVER ()), 5) AS total_scaled FROM r""")
def normalised_returns(spark, sf_dir):
    """AGG-25"""
    returns = _events(spark, sf_dir).groupBy("user_id").agg(F.sum("value").alias("total"))
    return metrics.normalised_returns(returns, "total").select("user_id", _r(F.col("total_scaled"), 5).alias("total_scaled"))


@query(f"""WITH {EV} SELECT user_id, round(avg(value) FILTER (frame_index < 10), 6) AS first_mean, round(avg(value) FILTER (frame_index >= n - 10), 6) AS last_mean, min(value) AS minimum FROM ev GROUP BY user_id""")
def series_window_means(spark, sf_dir):
    """AGG-27"""
    out = metrics.window_means(_frames(spark, sf_dir), "user_id", "frame_index", "value", 10)
    return out.select("user_id", _r(F.col("first_mean")).alias("first_mean"), _r(F.col("last_mean")).alias("last_mean"), "minimum")


@query("""SELECT user_id, round((count(*) - 1) / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600e6, 0), 6) AS rate FROM events GROUP BY user_id""")
def event_frequency(spark, sf_dir):
    """AGG-34"""
    rows = _events(spark, sf_dir).withColumn("hours", F.unix_micros(F.col("ts").cast("timestamp")) / 3600e6)
    return metrics.frequency(rows, "user_id", "hours").withColumn("rate", _r(F.col("rate")))


@query("""SELECT l_linestatus, round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS difference FROM lineitem GROUP BY l_linestatus""")
def ablation_difference(spark, sf_dir):
    """AGG-33"""
    return metrics.ablation_difference(_read(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_returnflag", "l_quantity", "N", "R").withColumn("difference", _r(F.col("difference")))


@query("""WITH p AS (SELECT a.label, unnest(range(64))::INTEGER AS position, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, position, round(avg(abs(x - y)), 6) AS mae FROM p GROUP BY label, position""")
def error_by_position(spark, sf_dir):
    """AGG-39"""
    v = _read(spark, sf_dir, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("other"))
    rows = v.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))).join(nxt, "vec_id")
    return metrics.error_by_position(rows, ["label"], "embedding", "other").withColumn("mae", _r(F.col("mae")))


from framegrain.plans import compared, governed, recipes, recorded, streamed  # noqa: E402, F401
