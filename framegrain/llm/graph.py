"""Connected components by alternating large-star and small-star steps (Kiveris et al.)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import written

#: A node with more than one in so many of all edge ends is a hub: there are at most so many hubs.
HUB_SHARE = 2_000


def _mapped(rows: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """rows (a, b) with `m`, the least of a and its partners; and that minimum of each a.

    Rows of hubs meet their minima by a broadcast (at most HUB_SHARE rows) and stay where they are; only the
    other rows are joined by shuffle, so that no task gets a hub's rows.
    """
    around = rows.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    minima = written(around, "minima")
    hub = F.col("n") > total / HUB_SHARE
    hubs = minima.filter(hub).select("a", "m")
    few = rows.join(F.broadcast(hubs), "a")
    rest = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(minima.filter(~hub).select("a", "m"), "a")
    return few.unionByName(rest), minima


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); a component is its smallest node.

    Each step maps the edges around a node to its smallest neighbour; minima come from partial aggregates,
    and hubs get theirs by a broadcast of bounded size. Edges are written after each round, and only counts
    and a checksum come to the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges, before = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"), None
    count = edges.count()
    for _ in range(rounds):
        around, _ = _mapped(both(edges), 2 * count)
        large = written(around.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), "large")
        around, minima = _mapped(large, 2 * count)
        small = around.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(minima.select("a", F.col("m").alias("b")))
        edges = written(small.filter("a != b").distinct(), "edges")
        count, seen = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if (count, seen) == before:
            break
        before = (count, seen)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
