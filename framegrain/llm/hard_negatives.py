"""Operator 13: hard negatives by exact search with a pivot table.

With M the largest norm, a row y becomes (y, sqrt(M^2 - |y|^2)) and a query q becomes (q, 0). Then
|q' - y'|^2 = |q|^2 + M^2 - 2 q.y, so inner products fall as Euclidean distances grow, and the triangle inequality over the
stored distances of y' to a few pivots brackets every score from both sides.

1. Pivot table, written once: each row with its distances to the pivots and a block (rows near one pivot, cut by hash into
   blocks of bounded size, so that many rows alike fill many blocks).
2. Search: blocks of anchors meet blocks of rows. A cell cuts its rows into leaves by distance to their pivot; a leaf whose
   bracket misses all that an anchor still looks for is skipped, the others are multiplied out exactly. Each cell returns
   at most `count` rows for an anchor and band, and Spark ranks what the cells found.
3. An anchor first looks through its own block only; the worst of `count` rows found there bounds what other cells return.

The search runs twice: for the positives (rows of the anchor's label), and for the negatives (other labels, inside the
band of scores that each positive sets).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framegrain.llm.common import written
from framegrain.llm.vectors import matrix, whole_vectors

SCALE = 256
PIVOTS = 16
#: Rows, chosen by hash, among which the pivots are chosen, each farthest from those before.
PIVOT_SAMPLE = 2_000
BLOCK_ROWS = 4_096
ANCHOR_ROWS = 2_048
LEAF_ROWS = 64
#: Rows of a cell that are multiplied out at once.
STRIPE_ROWS = 256
FREE = 1 << 60
#: Scores stay below this, so that a score and a place among a cell's rows fit one whole number.
MOST_SCORE = 1 << 46
OUTPUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def choose_pivots(rows: np.ndarray, top: float, pivots: int = PIVOTS) -> np.ndarray:
    """Augmented pivots among the given rows: the first, then each time the row farthest from all before."""
    augmented = np.hstack([rows, np.sqrt(np.maximum(0, top - (rows * rows).sum(axis=1)))[:, None]])
    picked = [0]
    nearest = np.linalg.norm(augmented - augmented[0], axis=1)
    while len(picked) < pivots and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(augmented - augmented[picked[-1]], axis=1))
    return augmented[picked]


def row_distances(rows: np.ndarray, top: float, pivots: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(0, top - (rows * rows).sum(axis=1)))
    return np.sqrt(np.maximum(0, 2 * top - 2 * (rows @ pivots[:, :-1].T + own[:, None] * pivots[:, -1])))


def query_distances(queries: np.ndarray, top: float, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (queries * queries).sum(axis=1)[:, None] + top - 2 * queries @ pivots[:, :-1].T))


def brackets(queries: np.ndarray, of_query: np.ndarray, lowest: np.ndarray, highest: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of queries with the rows of leaves, whose distances to the pivots lie in lowest..highest."""
    near = np.zeros((len(queries), len(lowest)))
    far = np.full(near.shape, np.inf)
    for p in range(lowest.shape[1]):
        at = of_query[:, p][:, None]
        np.maximum(near, lowest[:, p] - at, out=near)
        np.maximum(near, at - highest[:, p], out=near)
        np.minimum(far, at + highest[:, p], out=far)
    both = ((queries * queries).sum(axis=1) + top)[:, None]
    slack = 1e-6 * both + 1e-6
    return (both - far * far) / 2 - slack, (both - near * near) / 2 + slack


def search_cell(queries: dict, rows: dict, pivots: np.ndarray, top: float, same: bool, count: int) -> tuple[list[np.ndarray], int]:
    """The first `count` rows of each query and band inside this cell, and the number of pairs multiplied out.

    queries: x, label, rid and los, his of shape (queries, bands); rows: x, label, rid, id, dist. Returned: places of queries,
    bands, places of rows, scores. Order: higher scores first, then smaller ids, null ids last.
    """
    q, y = queries["x"], rows["x"]
    whole = float(np.abs(q).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, q.shape[1])
    if whole >= MOST_SCORE:
        raise OverflowError("inner products beyond 2^46")
    q, y = q.astype(np.float64), y.astype(np.float64)  # sums of products below 2^53 are exact
    order = np.lexsort((rows["dist"].min(axis=1), rows["dist"].argmin(axis=1)))
    place = np.empty(len(y), np.int64)
    place[np.lexsort((rows["rid"], rows["id"]))] = np.arange(len(y))[::-1]
    cuts = np.arange(0, len(y), LEAF_ROWS)
    lowest, highest = (f.reduceat(rows["dist"][order], cuts, axis=0) for f in (np.minimum, np.maximum))
    low, high = brackets(q, query_distances(q, top, pivots), lowest, highest, top)
    los, his = queries["los"], queries["his"]
    wanted = (high >= los.min(axis=1)[:, None]) & (low <= his.max(axis=1)[:, None])
    found, pairs = [], 0
    step = STRIPE_ROWS // LEAF_ROWS
    for leaf in range(0, len(cuts), step):
        some = wanted[:, leaf : leaf + step]
        mine = np.flatnonzero(some.any(axis=1))
        if not len(mine):
            continue
        at = order[leaf * LEAF_ROWS : (leaf + step) * LEAF_ROWS]
        at = at[np.repeat(some.any(axis=0), LEAF_ROWS)[: len(at)]]
        score = (q[mine] @ y[at].T).astype(np.int64)
        pairs += score.size
        alike = queries["label"][mine][:, None] == rows["label"][at]
        fits = alike & (queries["rid"][mine][:, None] != rows["rid"][at]) if same else ~alike
        key = score * BLOCK_KEY + place[at]
        for band in range(los.shape[1]):
            ok = fits & (score >= los[mine, band][:, None]) & (score <= his[mine, band][:, None])
            some_rows = np.flatnonzero(ok.any(axis=1))
            if not len(some_rows):
                continue
            masked = np.where(ok[some_rows], key[some_rows], -FREE * 4)
            if masked.shape[1] > count:
                best = np.argpartition(masked, masked.shape[1] - count, axis=1)[:, -count:]
            else:
                best = np.broadcast_to(np.arange(masked.shape[1]), masked.shape)
            r, c = np.nonzero(np.take_along_axis(masked, best, axis=1) > -FREE * 4)
            c = best[r, c]
            found.append((mine[some_rows[r]], np.full(len(r), band), at[c], score[some_rows[r], c]))
    if not found:
        return [np.zeros(0, np.int64)] * 4, pairs
    a, band, r, score = (np.concatenate(c) for c in zip(*found, strict=True))
    first = np.lexsort((-place[r], -score, band, a))
    a, band, r, score = a[first], band[first], r[first], score[first]
    start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (band[1:] != band[:-1]))))
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    keep = rank < count
    return [a[keep], band[keep], r[keep], score[keep]], pairs


#: More than the rows of any block.
BLOCK_KEY = 1 << 16


def pivot_table(x: DataFrame, d: int, every: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray, float, int]:
    """(rid, vec_id, label, x, dist, block, anchor) as a written table; the pivots, the square of the largest norm, the number of blocks.

    Rows equal in id, label and vector are one row.
    """
    spark = x.sparkSession
    base = written(x.select("vec_id", "label", "x").distinct().withColumn("rid", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    top = base.agg(F.max(square)).first()[0]
    if top is None:
        return base, np.zeros((0, d + 1)), 0.0, 0
    sample = base.orderBy(F.xxhash64("vec_id", "x", "label"), "rid").limit(PIVOT_SAMPLE).select("x").collect()
    chosen = choose_pivots(np.array([r["x"] for r in sample], float).reshape(-1, d), top, pivots)
    held = spark.sparkContext.broadcast((chosen, top))  # at most `pivots` vectors

    def task(batches):
        import pyarrow as pa

        for b in batches:
            dist = row_distances(matrix(b.column("x"), d).astype(np.float64), held.value[1], held.value[0])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(dist) + 1, dtype=np.int32) * dist.shape[1]), pa.array(dist.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat, pa.array(dist.argmin(axis=1).astype(np.int32))], [*b.schema.names, "dist", "near"])

    near = written(base.mapInArrow(task, "vec_id long, label long, x array<long>, rid long, dist array<double>, near int"), "distances")
    sizes = {r["near"]: r["count"] for r in near.groupBy("near").count().collect()}  # one row a pivot
    blocks, first, salts = 0, [], []
    for p in range(len(chosen)):
        first.append(blocks)
        salts.append(max(1, math.ceil(sizes.get(p, 0) / block_rows)))
        blocks += salts[-1]
    pick = lambda values: F.array(*[F.lit(v) for v in values])[F.col("near")]
    block = pick(first) + F.pmod(F.xxhash64("rid"), pick(salts)).cast("int")
    anchor = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    return near.select("rid", "vec_id", "label", "x", "dist", block.alias("block"), anchor.alias("anchor")), chosen, top, blocks


def _cells(anchors: DataFrame, table: DataFrame, d: int, pivots: np.ndarray, top: float, groups: int, same: bool, count: int) -> DataFrame:
    """anchors (rid, label, x, los, his, group, block) against the rows of their blocks: (rid, band, vec_id, score)."""
    held = table.sparkSession.sparkContext.broadcast((pivots, top))

    def cell(left, right):
        import pyarrow as pa

        names = ["rid", "band", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], pa.int32() if k == "band" else pa.int64()) for k in names})
        number = lambda t, k: t.column(k).to_numpy()
        bands = len(left.column("los")[0])
        queries = {k: number(left, k) for k in ("rid", "label")} | {"x": matrix(left.column("x"), d)} | {k: matrix(left.column(k), bands) for k in ("los", "his")}
        ids = right.column("row_id").combine_chunks()
        rows = {"rid": number(right, "row_rid"), "label": number(right, "row_label"), "x": matrix(right.column("row_x"), d), "dist": matrix(right.column("dist"), len(held.value[0]))}
        rows["id"] = ids.fill_null((1 << 63) - 1).to_numpy()
        (a, band, r, score), _ = search_cell(queries, rows, *held.value, same, count)
        return pa.table({"rid": pa.array(queries["rid"][a]), "band": pa.array(band.astype(np.int32)), "vec_id": ids.take(pa.array(r)), "score": pa.array(score)})

    # Columns of the two sides must not share attributes, as both come from one table.
    own = {"rid": "row_rid", "vec_id": "row_id", "label": "row_label", "x": "row_x", "dist": "dist", "block": "row_block"}
    rows = table.select(*[F.col(k).alias(v) for k, v in own.items()]).withColumn("row_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = anchors.select("rid", "label", "x", "los", "his", "block", "group")
    return asked.groupBy("block", "group").cogroup(rows.groupBy("row_block", "row_group")).applyInArrow(cell, "rid long, band int, vec_id long, score long")


def search(anchors: DataFrame, table: DataFrame, d: int, pivots: np.ndarray, top: float, blocks: int, groups: int, same: bool, count: int) -> DataFrame:
    """The first `count` rows for each anchor and band: (rid, band, vec_id, score, place), place from 1.

    anchors: rid, label, x, block, group, los, his. A band holds the scores from its lo to its hi.
    """
    at_home = _cells(anchors, table, d, pivots, top, groups, same, count)
    full = at_home.groupBy("rid", "band").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("least")).filter(F.col("c") == count)
    raised = full.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("band", "least"))).alias("least"))  # one entry a band
    lo = F.transform("los", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at("least", i.cast("int")), v)))
    asked = written(anchors.join(raised, "rid", "left").withColumn("los", F.when(F.col("least").isNull(), F.col("los")).otherwise(lo)).drop("least"), "anchors")
    everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = _cells(everywhere, table, d, pivots, top, groups, same, count)
    best = W.partitionBy("rid", "band").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= count)


def mine(
    df: DataFrame, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), every: int = 100, scale: int = SCALE, pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor (ids divisible by `every`).

    The positives of an anchor are its first other rows of the same label; each of them takes the first rows of another label
    whose score is within `band` percent of the positive's. Higher scores come first, ties by smaller id, null ids last.
    Rows with a null label or a null vector, a null or non-finite entry, or fewer entries than the longest vector take no
    part. A row with a null id is no anchor, but may be a positive or a negative. Rows equal in id, label and vector are one
    row; rows with one id and different vectors are different rows, each an anchor of its own. An anchor without
    positives, and a positive without rows in its band, give no rows; an empty input gives an empty result. Other columns are
    ignored. Scores of 2^46 and more raise an error.
    """
    spark = df.sparkSession
    x, d = whole_vectors(df.filter(F.col(label_col).isNotNull()).withColumn("label", F.col(label_col).cast("long")), scale, 0, id_col, vec_col, keep=("label",))
    table, chosen, top, blocks = pivot_table(x, d, every, pivots, min(block_rows, BLOCK_KEY // 4))
    if not blocks:
        return spark.createDataFrame([], OUTPUT)
    anchors = table.filter("anchor")
    groups = math.ceil(anchors.count() / anchor_rows)
    if not groups:
        return spark.createDataFrame([], OUTPUT)
    anchors = anchors.select("rid", "vec_id", "label", "x", "block", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups)).cast("int").alias("group"))
    bounds = lambda lo, hi: [F.array(F.lit(lo).cast("long")).alias("los"), F.array(F.lit(hi).cast("long")).alias("his")]
    alike = written(search(anchors.select("*", *bounds(-FREE, FREE)), table, d, chosen, top, blocks, groups, True, positives), "positives")

    scores = alike.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # at most `positives` entries
    tenth = lambda share, up: F.transform("p", lambda s: (F.ceil if up else F.floor)((s["score"] * share).cast("decimal(38,0)") / 100).cast("long"))
    # Every anchor has as many bands; those without a positive hold no score.
    filled = lambda a, v: F.slice(F.concat(a, F.array_repeat(F.lit(v).cast("long"), positives)), 1, positives)
    asked = anchors.join(scores, "rid").withColumns({"los": filled(tenth(band[0], True), FREE), "his": filled(tenth(band[1], False), -FREE)}).drop("p")
    other = search(asked, table, d, chosen, top, blocks, groups, False, negatives)
    named = alike.select("rid", (F.col("place") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        other.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "place": "rank"})
        .join(named, ["rid", "band"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def relabelled(df: DataFrame) -> DataFrame:
    """Labels as the query asks for: (label + 1) % 10 where the id is divisible by 7."""
    return df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_hard_negatives(spark, sf_dir):
    return mine(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP13_SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)
),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
