"""Operator 2: n-gram Jaccard join with Bayesian pruning of candidates.

1. Texts become sets of word shingles; texts with equal sets are one node, however many copies there are.
2. MinHash bands put nodes into buckets. At a similarity of 0.8, 42 bands of 6 miss a pair three times in a
   million. Buckets link their members to one of them; connected components of those links are candidate groups.
3. A group is compared the way that meets fewer pairs: all its nodes with each other, as suits near copies, or bucket by
   bucket, as suits chains of texts that are half alike; there a pair counts in its first common band only. A node's
   text travels once to each task that compares it.
4. Pairs compare their MinHash values 32 at a time. A pair is dropped when, after m of n equal values and under a
   uniform prior, the posterior probability of reaching the threshold is below `tolerance`. The pairs that remain are
   verified exactly on their sets.
5. Links are counted where they are found; what leaves a task is a row for each node, not for each pair.

Groups and buckets of more than `tile` nodes, or of more text than TILE_BYTES, are split into blocks, and each pair of blocks
is a task of its own.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import bloom_bits, bloom_hit, mix64, shingle_sets, utf8, written
from framegrain.llm.graph import connected_components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
STEP = 32
TOLERANCE = 1e-7
TILE = 1_500
#: Bytes of text that a task holds, about.
TILE_BYTES = 64 << 20
#: Groups of up to so many nodes are compared whole: that is at most some hundred pairs.
WHOLE = 24
#: Rows that a task remembers to have sent to the comparison.
SENT = 200_000

_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits each) of a set of 64-bit hashes; all ones for the empty set."""
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(low, np.multiply.outer(shingles[at : at + 512], _FACTORS).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1, dtype=np.uint64)
        for v in sig.reshape(BANDS, ROWS).astype(np.uint64).T:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + v)
    return h.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, steps: int = BANDS * ROWS // STEP) -> list[int]:
    """Equal values out of STEP, 2 * STEP, ... below which P(similarity >= threshold) < tolerance.

    The posterior after m of n is Beta(m + 1, n - m + 1); its tail beyond t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, STEP * steps + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def linked(
    sets: list[np.ndarray], weights: np.ndarray, groups: np.ndarray, sides: np.ndarray | None, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
    who: np.ndarray | None = None, band: np.ndarray | None = None,
):
    """(links, sums of the partners' weights, parents, pairs): over pairs of one group at or above the threshold.

    An entry is a set in a group; `who` names its set (None: entry i is set i). sides: None for all pairs; otherwise pairs
    across sides 0 and 1 only. band: for each entry the band whose bucket its group is, or -1; in a bucket a pair counts only
    if no earlier band has it. parents join linked sets; pairs: how many were compared.
    """
    who = np.arange(len(sets)) if who is None else who
    band = np.full(len(who), -1) if band is None else band
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((sizes[who], groups))
    who, groups, band = who[order], groups[order], band[order]
    sides = None if sides is None else sides[order]
    sig = np.array([signature(s) for s in sets]).reshape(len(sets), -1)
    bands = np.array([band_keys(x) for x in sig]).reshape(len(sets), -1) if (band > 0).any() else None
    blocks = [np.ascontiguousarray(sig[:, k : k + STEP]) for k in range(0, sig.shape[1] - STEP + 1, STEP)]
    least = least_matches(threshold, tolerance, len(blocks))
    _, codes = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), return_inverse=True)
    ends = np.cumsum(sizes)
    flag = np.zeros(int(codes.max(initial=0)) + 1, bool)
    stop, size = np.searchsorted(groups, groups, "right"), sizes[who]
    links, heavy, parent, pairs = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), list(range(len(sets))), 0

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for e, a in enumerate(who.tolist()):
        # Sizes ascend within a group, and a partner has at most sizes[a] / threshold shingles.
        far = e + 1 + int(np.searchsorted(size[e + 1 : stop[e]], sizes[a] / threshold + 1e-9, "right"))
        near = np.arange(e + 1, far)
        if sides is not None:
            near = near[sides[near] != sides[e]]
        near = who[near]
        pairs += len(near)
        got = np.zeros(len(near), np.int64)
        for block, need in zip(blocks, least, strict=True):
            if not len(near):
                break
            got += (block[near] == block[a]).sum(axis=1)
            near, got = near[got >= need], got[got >= need]
        if len(near) and band[e] > 0:
            near = near[~(bands[near, : band[e]] == bands[a, : band[e]]).any(axis=1)]
        if not len(near):
            continue
        own = codes[ends[a] - sizes[a] : ends[a]]
        flag[own] = True
        spans = sizes[near]
        at = np.repeat(ends[near] - spans - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        common = np.add.reduceat(flag[codes[at]], np.concatenate(([0], np.cumsum(spans)[:-1])), dtype=np.int64)
        flag[own] = False
        near = near[common >= threshold * (sizes[a] + spans - common) - 1e-9]
        links[a] += len(near)
        links[near] += 1
        heavy[a] += weights[near].sum()
        heavy[near] += weights[a]
        top = root(a)
        for b in near.tolist():
            other = root(b)
            if other != top:
                parent[other] = top
    return links, heavy, np.array([root(i) for i in range(len(sets))], np.int64), pairs


def _keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), "text")


def row_keys(doc_id, text):
    """Two 64-bit hashes that name a row by id and text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text, doc_id).alias("d1"), F.xxhash64(doc_id, text, F.lit(7)).alias("d2")]


def jaccard_join(df: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = TOLERANCE, tile: int = TILE, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each input row: doc_id, class_id, links, kept, d1, d2.

    links: other rows whose similarity is at or above the threshold, copies counted. class_id: smallest id
    among the rows that links connect (null if all are null). kept: exactly one row of each class, the one
    with that id. Texts of fewer than `width` words have one shingle of all their words. Texts without words
    (null, empty, blank) have no links and are classes of their own, each kept. An empty input gives an
    empty result; other columns are ignored.
    """
    spark = df.sparkSession
    docs = _keys(df, id_col, text_col)

    def features(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            texts = utf8(b.column(3))
            digests, keys = [], []
            for at in range(0, len(texts), 256):
                for s in shingle_sets(texts[at : at + 256], width):
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(digests, pa.binary()), bands, sizes], ["doc_id", "d1", "d2", "digest", "bands", "bytes"])

    # `number` tells rows apart that are alike in id and text.
    feats = written(docs.mapInArrow(features, "doc_id long, d1 long, d2 long, digest binary, bands array<long>, bytes long").withColumn("number", F.monotonically_increasing_id()), "shingles")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2", "number", "bytes")
    nodes = feats.filter("digest is not null").groupBy("digest").agg(F.min(one).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "rep", "copies", "bands"), "nodes")

    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = written(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = written(keyed.join(buckets, "key"), "members")
    groups = written(connected_components(members.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))).withColumnRenamed("component", "g"), "groups")

    # All nodes of a group together, or its buckets one by one: whichever has fewer pairs.
    whole = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    apart = buckets.join(groups, F.col("pivot") == F.col("node")).groupBy("g").agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1)).alias("apart"))
    ways = whole.join(apart, "g").select("g", ((F.col("m") > WHOLE) & (F.col("apart") < F.col("m").cast("double") * (F.col("m") - 1))).alias("by_bucket"))
    sizes = nodes.select("node", F.col("rep.bytes").alias("bytes"))
    chosen = groups.join(ways, "g").join(sizes, "node")
    units = chosen.filter("NOT by_bucket").select("node", "g", F.lit(-1).alias("band"), "bytes")
    units = written(units.unionByName(chosen.filter("by_bucket").join(members, "node").select("node", F.col("key").alias("g"), "band", "bytes")), "units")

    totals = units.groupBy("g", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("all"))
    entries, amount = units.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    bins = max(1, entries // tile, amount // TILE_BYTES)
    split = F.greatest(F.ceil(F.col("m") / F.lit(tile)), F.least(F.col("m"), F.ceil(F.col("all") / F.lit(TILE_BYTES)))).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("split")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("split") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    placed = (
        units.join(totals, ["g", "band"]).withColumn("split", split).withColumn("block", block)
        .withColumn("t", F.explode(tiles))
        .withColumn("task", F.when(F.col("split") > 1, F.xxhash64("g", "band", "t.i", "t.j")).otherwise(F.pmod(F.xxhash64("g"), F.lit(bins))))
        .groupBy("node", "task").agg(F.collect_list(F.struct("g", "band", "block", (F.col("t.i") != F.col("t.j")).alias("across"))).alias("places"))  # at most one a band
        .join(nodes.select("node", "rep.d1", "rep.d2", "copies"), "node")
    )
    wanted = spark.sparkContext.broadcast(bloom_bits(groups.join(nodes, "node").select(F.col("rep.d1").alias("k"))))

    def only(batches):
        sent: set = set()
        for b in batches:
            d1, d2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            hit = bloom_hit(wanted.value, d1)
            for i in np.flatnonzero(hit).tolist():  # rows alike are sent once by a task
                name = (int(d1[i]), int(d2[i]))
                if name in sent:
                    hit[i] = False
                elif len(sent) < SENT:
                    sent.add(name)
            yield b.take(np.flatnonzero(hit)) if not hit.all() else b

    texts = docs.mapInArrow(only, "doc_id long, d1 long, d2 long, text string").select("d1", "d2", "text")

    def compare(pdf):
        import pandas as pd

        pdf = pdf.drop_duplicates("node")
        sets = []
        for at in range(0, len(pdf), 256):
            sets += shingle_sets([t.encode() for t in pdf.text.iloc[at : at + 256]], width)
        who = np.repeat(np.arange(len(pdf)), [len(p) for p in pdf.places])
        g, band, block, across = (np.array([place[k] for places in pdf.places for place in places]) for k in ("g", "band", "block", "across"))
        _, g = np.unique(g, return_inverse=True)
        # Tasks of split groups hold one pair of blocks; the others hold whole groups.
        sides = (block == block.max()).astype(int) if across.any() else None
        links, heavy, roots, _ = linked(sets, pdf.copies.to_numpy(), g * (BANDS + 1) + band + 1, sides, threshold, tolerance, who, band)
        node = pdf.node.to_numpy()
        out = pd.DataFrame({"node": node, "links": heavy, "root": node[roots]})
        return out[links > 0]

    counted = placed.join(texts, ["d1", "d2"]).groupBy("task").applyInPandas(compare, "node long, links long, root long")
    counted = written(counted, "links")
    classes = connected_components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    found = counted.groupBy("node").agg(F.sum("links").alias("links"))
    per_node = (
        nodes.select("node", "digest", "rep", "copies").join(found, "node", "left").join(classes, "node", "left")
        .withColumn("c", F.coalesce("component", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    per_node = written(per_node.select("digest", "links", "c", "rep"), "classes")
    heads = per_node.groupBy("c").agg(F.min("rep").alias("head"))
    per_node = per_node.join(heads, "c").select("digest", "links", F.col("head.doc_id").alias("class_id"), F.col("head.number").alias("first"))
    rows = feats.select("doc_id", "d1", "d2", "digest", "number")
    worded = rows.filter("digest IS NOT NULL").join(per_node, "digest").select("doc_id", "class_id", "links", (F.col("number") == F.col("first")).alias("kept"), "d1", "d2")
    none = rows.filter("digest IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("kept"), "d1", "d2")
    return worded.unionByName(none)


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "links", "kept")


#: The contract by brute force as DuckDB SQL: all pairs with a common shingle, which suits small tables.
OP2_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) >= {WIDTH} THEN [array_to_string(ws[k:k + {WIDTH - 1}], ' ') FOR k IN range(1, len(ws) - {WIDTH - 2})] ELSE [array_to_string(ws, ' ')] END) AS v FROM d WHERE len(ws) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.v = b.v AND a.rid <> b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE c >= {THRESHOLD} * (a.n + b.n - c) - 1e-9),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(doc_id) AS least FROM r JOIN d ON d.rid = r.y GROUP BY x),
k AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, coalesce(links, 0) AS links, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM d LEFT JOIN c ON c.x = rid LEFT JOIN k ON k.x = rid"""
