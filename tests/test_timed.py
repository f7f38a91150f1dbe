"""Leases and throttles over several micro-batches: what timers put out is what a look at all rows gives."""

import uuid
from datetime import datetime, timedelta, timezone

import pytest

from framegrain.streaming import operators as streams

pytest.importorskip("google.protobuf")
from framegrain.streaming import timed  # noqa: E402

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timed.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, batches, schema, make):
    """Rows that `make` gives for a stream of one file a micro-batch."""
    place = tmp_path / uuid.uuid4().hex
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in/{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in/*")
    out = make(stream)
    got = []
    write = lambda batch, number: got.extend((number, *r) for r in batch.collect())
    out.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return got


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_leases(rocks, tmp_path):
    """k is extended across batches and runs out by the watermark alone; m is taken over, then released; n runs out in view of its next row."""
    schema = "k string, t timestamp, i int, who string, gives boolean"
    batches = [
        [("k", at(0), 0, "a", False), ("m", at(1), 1, "a", False), ("n", at(2), 2, "z", False)],
        [("k", at(50), 3, "a", False), ("m", at(60), 4, "b", False)],
        [("m", at(100), 5, "a", True), ("m", at(110), 6, "b", True), ("n", at(300), 7, "y", False)],
        [("m", at(301), 8, "c", False)],
    ]
    got = run(rocks, tmp_path, batches, schema, lambda s: timed.leases(s, "k", "t", "i", "who", "gives", 100))
    naive = lambda x: x.replace(tzinfo=None) if x.tzinfo is None else x
    found = sorted((r[1], r[2], round((r[4] - r[3]).total_seconds()), r[5]) for r in got)
    assert found == [("k", "a", 150, "expired"), ("m", "a", 59, "taken over"), ("m", "b", 50, "released"), ("n", "z", 100, "expired")] and naive(got[0][3])
    moves = rocks.createDataFrame([("k", False, True), ("m", True, True), ("n", True, False)], "k string, here boolean, there boolean")
    ended = rocks.createDataFrame([r[1:] for r in got], "key string, holder string, began timestamp, ended timestamp, reason string")
    assert {(r.k, r.action) for r in timed.stuck(moves, ended, "k", "here", "there").collect()} == {("k", "verify"), ("n", "again")}


def test_throttle(rocks, tmp_path):
    batches = [[("k", at(0), 0, 1.0), ("k", at(3), 1, 2.0)], [("k", at(5), 2, 3.0), ("j", at(6), 3, 9.0)], [("k", at(25), 4, 4.0)], [("j", at(60), 5, 8.0)]]
    got = run(rocks, tmp_path, batches, "k string, t timestamp, i int, v double", lambda s: timed.throttled(s, "k", "t", "i", "v", 10))
    began = min(r[2] for r in got)
    assert sorted((r[1], round((r[2] - began).total_seconds()), r[3]) for r in got) == [("j", 6, 9.0), ("j", 60, 8.0), ("k", 0, 1.0), ("k", 10, 3.0), ("k", 25, 4.0)]


def test_order_across_arrow_batches(spark):
    """Rows of a key that fill many Arrow batches are judged in order of their steps, not of arrival."""
    import pandas as pd

    parts = [pd.DataFrame({"s": [s], "v": [[float(s)]]}) for s in (5, 1, 4, 2, 3)]
    assert [r.s for pdf in streams.in_order(iter(parts), ["s"], 2) for r in pdf.itertuples()] == [1, 2, 3, 4, 5]
    assert list(streams.in_order(iter([]), ["s"])) == []
