"""Queries of streams: `events` as a file stream, run to its end; the result is the table that it wrote."""

from __future__ import annotations

import uuid
from importlib.util import find_spec

from pyspark.sql import functions as F

from framegrain.plans.registry import EV, query, r6, read, read_events, read_frames
from framegrain.session import shared_dir
from framegrain.streaming import operators as streams
from framegrain.streaming import timed


def _place(spark) -> str:
    return f"{shared_dir(spark)}/framegrain/stream-{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    """events as a stream; watermarks need a timestamp with zone."""
    schema = read_events(spark, sf_dir).schema
    return spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(stream, mode: str):
    """The table that a stream leaves."""
    spark, place = stream.sparkSession, _place(stream.sparkSession)
    write = lambda batch, number: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/out")
    schema = stream.schema
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/out")


@query("""SELECT event_type, 'online' AS store, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type UNION ALL SELECT event_type, 'offline', count(*), round(sum(value), 4) FROM events WHERE event_type = 'error' GROUP BY event_type""")
def stream_route(spark, sf_dir):
    """FLT-02, STM-02"""
    place = _place(spark)
    stream = _stream(spark, sf_dir).withColumn("is_intervention", F.col("event_type") == "error").withColumn("state", F.array("value"))
    streams.route(stream, f"{place}/online", f"{place}/offline", f"{place}/state", vectors=("state",)).awaitTermination()
    out = None
    for store in ("online", "offline"):
        rows = spark.read.schema(stream.schema).parquet(f"{place}/{store}").groupBy("event_type").agg(F.lit(store).alias("store"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    out = streams.windowed(_stream(spark, sf_dir), "ts", ["event_type"], [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")], "6 hours", late="30 days")
    return _finished(out, "complete").select(F.col("window.start").cast("long").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    out = streams.sessions(_stream(spark, sf_dir), "ts", "user_id", "4 hours", [F.count(F.lit(1)).alias("n")], late="30 days")
    return _finished(out, "complete").select("user_id", F.col("session_window.start").cast("long").alias("start_s"), "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, event_type = 'error' AS must, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, value, value AS last, true AS go FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, e.value, CASE WHEN e.must OR abs(e.value - r.last) >= 25 THEN e.value ELSE r.last END, e.must OR abs(e.value - r.last) >= 25 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id AS timestep, [value] AS state FROM r WHERE go""")
def stream_similarity_dedupe(spark, sf_dir):
    """STM-03"""
    stream = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("timestep"), F.array("value").alias("state"), (F.col("event_type") == "error").alias("must_go"))
    return _finished(streams.similarity_filter(stream, "user_id", "timestep", "state", "must_go", 25.0), "append")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id // 40 AS f, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, f, [value, value + 1, value + 2, value + 3] AS q FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, e.f, list_transform([0, 1, 2, 3], lambda k: CASE WHEN e.f + k - r.f BETWEEN 0 AND 3 THEN 0.3 * r.q[e.f + k - r.f + 1] + 0.7 * (e.value + k) ELSE e.value + k END) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, f + k AS step, round(q[k + 1] + 1e-9, 6) AS action FROM r, range(4) t(k)""")
def stream_chunk_merge(spark, sf_dir):
    """UDF-03: Each event brings a chunk of four steps from event_id div 40 on, so a user's chunks often overlap."""
    chunk = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.col("value") + k)
    first = F.expr("event_id div 40")
    stream = _stream(spark, sf_dir).select("user_id", "event_id", first.alias("first"), chunk.alias("actions"), (first - 1).alias("executed"))
    return _finished(streams.merge_chunks(stream, "user_id", "event_id", "first", "actions", "executed"), "append").withColumn("action", r6(F.col("action") + 1e-9))  # ties of short decimals round alike here and in SQL


@query("""SELECT user_id, count(*) AS n, round((count(*) - 1) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600e6), 6) AS rate FROM events GROUP BY user_id""")
def stream_running_rate(spark, sf_dir):
    """STM-05"""
    stream = _stream(spark, sf_dir).select("user_id", (F.unix_micros("ts") / 3600e6).alias("hours"))
    out = _finished(streams.running_rate(stream, "user_id", "hours"), "append")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), r6(F.max_by("rate", "n")).alias("rate"))


@query("""SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def stream_latest_only(spark, sf_dir):
    """SRT-05, STM-06"""
    return _finished(streams.latest_only(_stream(spark, sf_dir), "user_id", "value", "event_id"), "complete")


@query("""SELECT event_id % 7 = 0 AS late, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1""")
def stream_incremental_poll(spark, sf_dir):
    """STM-08"""
    place = _place(spark)
    events = read_events(spark, sf_dir)
    done = events.filter("event_type = 'click'").select("event_id")
    streams.poll(spark, f"{sf_dir}/events.parquet*", events.schema, lambda: done, "event_id", lambda batch, number: batch.write.mode("append").parquet(f"{place}/out"), f"{place}/state").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{place}/out").groupBy((F.col("event_id") % 7 == 0).alias("late")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, sha256(text) AS sha, true AS complete, greatest(ceil(length(text) / 500.0), 1)::BIGINT AS parts FROM documents""")
def message_parts_roundtrip(spark, sf_dir):
    """SRC-18, STM-12"""
    parts = streams.in_parts(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 500)
    whole = streams.reassembled(parts, "doc_id", "part", "kind", "text")
    return whole.join(parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts")), "doc_id").select("doc_id", F.sha2("text", 256).alias("sha"), "complete", "parts")


@query(f"""WITH {EV}, n AS (SELECT user_id, frame_index + 10 AS step, value AS action FROM ev), o AS (SELECT u.user_id, frame_index AS step, value AS action FROM (SELECT DISTINCT user_id FROM ev) u JOIN ev ON ev.user_id = u.user_id + 1)
SELECT n.user_id, n.step, round(CASE WHEN o.action IS NULL THEN n.action ELSE 0.3 * o.action + 0.7 * n.action END, 6) AS action FROM n LEFT JOIN o USING (user_id, step) WHERE n.step > 14""")
def chunk_overlap_merge(spark, sf_dir):
    """STM-04: Each user's frames, ten steps on, merged onto those of the next user: one long chunk a user."""
    rows = read_frames(spark, sf_dir).select("user_id", F.col("frame_index").alias("step"), F.col("value").alias("action"))
    users = rows.select("user_id").distinct()
    executed = users.withColumn("executed", F.lit(14).cast("long"))
    out = streams.merged_batch(rows.withColumn("user_id", F.col("user_id") - 1).join(users, "user_id"), rows.withColumn("step", F.col("step") + 10), executed, ["user_id"])
    return out.withColumn("action", r6(F.col("action")))


@query(f"""WITH {EV}, c AS (SELECT user_id, frame_index // 10 - j AS chunk, frame_index AS step, value + 10 * j + frame_index % 10 AS action FROM ev, (VALUES (0), (1), (2)) t(j) WHERE frame_index // 10 >= j)
SELECT n.user_id, n.chunk, n.step, round(CASE WHEN o.action IS NULL THEN n.action ELSE 0.3 * o.action + 0.7 * n.action END, 6) AS action
FROM c n LEFT JOIN c o ON o.user_id = n.user_id AND o.chunk = n.chunk - 1 AND o.step = n.step WHERE n.chunk = 0 OR n.step > 10 * n.chunk + 4""")
def chunk_overlap_merge_all(spark, sf_dir):
    """Each user's chunks of 30 steps, one every 10 steps, merged with the one before; a chunk arrives 4 steps late."""
    back = F.explode(F.sequence(F.lit(0), F.least(F.lit(2), F.floor(F.col("frame_index") / 10).cast("int")))).alias("j")
    rows = read_frames(spark, sf_dir).select("user_id", "frame_index", "value", back)
    chunk = F.floor(F.col("frame_index") / 10) - F.col("j")
    new = rows.select("user_id", chunk.alias("chunk"), F.col("frame_index").alias("step"), (F.col("value") + 10 * F.col("j") + F.col("frame_index") % 10).alias("action"))
    executed = new.filter("chunk > 0").select("user_id", "chunk", (10 * F.col("chunk") + 4).alias("executed"))
    out = streams.merged_batch(new.withColumn("chunk", F.col("chunk") + 1), new, executed, ["user_id", "chunk"])
    return out.withColumn("action", r6(F.col("action")))


#: Spark's state with timers talks to Python in protocol buffers.
timed_query = query if find_spec("google") and find_spec("google.protobuf") else lambda sql: lambda f: f


def _timed(spark, run):
    """run() with the state store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, timed.PROVIDER)
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


@timed_query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS holder, event_type = 'purchase' AS gives, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, NULL::VARCHAR AS h, NULL::BIGINT AS b, NULL::BIGINT AS u, [] ::STRUCT(h VARCHAR, b BIGINT, e BIGINT, w VARCHAR)[] AS o FROM (SELECT DISTINCT user_id FROM e) UNION ALL
SELECT user_id, i, CASE WHEN gives AND h0 IS NOT DISTINCT FROM holder THEN NULL WHEN gives THEN h0 ELSE holder END, CASE WHEN gives AND h0 IS NOT DISTINCT FROM holder THEN NULL WHEN gives THEN b0 WHEN h0 = holder THEN b0 ELSE t END,
  CASE WHEN gives AND h0 IS NOT DISTINCT FROM holder THEN NULL WHEN gives THEN u0 ELSE t + 10800000 END,
  list_concat(list_concat(CASE WHEN h IS NOT NULL AND u <= t THEN [{'h': h, 'b': b, 'e': u, 'w': 'expired'}] ELSE [] END, CASE WHEN gives AND h0 = holder THEN [{'h': h0, 'b': b0, 'e': t, 'w': 'released'}] ELSE [] END), CASE WHEN NOT gives AND h0 <> holder THEN [{'h': h0, 'b': b0, 'e': t, 'w': 'taken over'}] ELSE [] END)
  FROM (SELECT r.user_id, e.i, r.h, r.b, r.u, e.holder, e.gives, e.t, CASE WHEN r.u <= e.t THEN NULL ELSE r.h END AS h0, CASE WHEN r.u <= e.t THEN NULL ELSE r.b END AS b0, CASE WHEN r.u <= e.t THEN NULL ELSE r.u END AS u0 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)),
x AS (SELECT user_id, unnest(o) AS o FROM r UNION ALL SELECT user_id, {'h': h, 'b': b, 'e': u, 'w': 'expired'} FROM r WHERE h IS NOT NULL AND i = (SELECT max(i) FROM e WHERE e.user_id = r.user_id) AND u <= (SELECT max(t) FROM e))
SELECT user_id, o.h AS holder, o.b AS began_ms, o.e AS ended_ms, o.w AS reason FROM x""")
def stream_leases(spark, sf_dir):
    """STM-09, STM-13: leases that are released, taken over or run out."""
    stream = _stream(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "purchase").alias("gives"))
    out = _timed(spark, lambda: _finished(timed.leases(stream, "user_id", "ts", "event_id", "event_type", "gives", 10_800), "append"))
    return out.select(F.col("key").alias("user_id"), "holder", F.unix_millis("began").alias("began_ms"), F.unix_millis("ended").alias("ended_ms"), "reason")


@timed_query("""WITH RECURSIVE e AS (SELECT user_id, value, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
r AS (SELECT user_id, i, t AS last, false AS waits, 0.0::DOUBLE AS held, [{'t': t, 'v': value}] AS o FROM e WHERE i = 1 UNION ALL
SELECT user_id, i, CASE WHEN l0 + 7200000 <= t THEN t ELSE l0 END, l0 + 7200000 > t, CASE WHEN l0 + 7200000 > t THEN value ELSE held END, list_concat(CASE WHEN due THEN [{'t': l0, 'v': held}] ELSE [] END, CASE WHEN l0 + 7200000 <= t THEN [{'t': t, 'v': value}] ELSE [] END)
  FROM (SELECT r.user_id, e.i, e.t, e.value, r.held, r.waits AND r.last + 7200000 <= e.t AS due, CASE WHEN r.waits AND r.last + 7200000 <= e.t THEN r.last + 7200000 ELSE r.last END AS l0, r.waits FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)),
x AS (SELECT user_id, unnest(o) AS o FROM r UNION ALL SELECT user_id, {'t': last + 7200000, 'v': held} FROM r WHERE waits AND i = (SELECT max(i) FROM e WHERE e.user_id = r.user_id) AND last + 7200000 <= (SELECT max(t) FROM e))
SELECT user_id, o.t AS at_ms, round(o.v, 6) AS value FROM x""")
def stream_throttled(spark, sf_dir):
    """STM-06: the latest value of a user, pushed every two hours at most."""
    out = _timed(spark, lambda: _finished(timed.throttled(_stream(spark, sf_dir), "user_id", "ts", "event_id", "value", 7_200), "append"))
    return out.select(F.col("key").alias("user_id"), F.unix_millis("at").alias("at_ms"), r6(F.col("value")).alias("value"))
