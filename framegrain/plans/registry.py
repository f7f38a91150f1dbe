"""Where queries over the driver tables register, with the SQL that gives the same rows.

`events` plays the frames (episode = user_id, order = ts, event_id; value = signal), `embeddings` the vectors,
`documents` and `labels` the records and scores, orders and customers the inventory.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from framegrain.operators import frames

ORDER = ["ts", "event_id"]
QUERIES: dict = {}
ORACLES: dict = {}

#: Frames with their index, as SQL.
EV = """ev AS (SELECT event_id, user_id, ts, event_type, value, props,
  row_number() OVER w - 1 AS frame_index, count(*) OVER (PARTITION BY user_id) AS n
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_events(spark, sf_dir):
    return read(spark, sf_dir, "events")


def read_frames(spark, sf_dir):
    return frames.number_frames(read_events(spark, sf_dir), "user_id", ORDER)


def r6(c, digits=6):
    return F.round(c, digits)
