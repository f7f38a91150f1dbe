"""Operator 8: toxicity by subword-bag embeddings.

A text is the average of the vectors of its character n-grams (word ends marked, so short words are n-grams
themselves) under a linear softmax; vectors and softmax are trained together in numpy on at most
2 * `per_class` labelled rows. A misspelling that training never saw shares most n-grams with its word.
Scoring needs one number for each hash bucket (vector times softmax weights) and runs on Arrow batches.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import SEED, crc_fold, mix64, written

GRAMS = (3, 4, 5, 6)
LOG2_BUCKETS = 17
DIMS = 8
EPOCHS, BATCH, RATE = 10, 16, 200.0
#: Labelled rows of each class, and bytes of all their texts, that the fit takes at most.
PER_CLASS = 1_000
SAMPLE_BYTES = 32 << 20
#: Characters whose n-grams are in memory at once, some 50 bytes for each.
PART = 1 << 20
_SPACE = re.compile(r"\s")
#: A text of more than this part of SAMPLE_BYTES is not trained on; like any other it is scored.
LONGEST = 16


def gram_buckets(text: str) -> np.ndarray:
    """Bucket of every n-gram in a text, words lower-cased and separated by single marks."""
    code = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inner = np.concatenate(([0], np.cumsum(code == 32)))
    out, h = [], code
    with np.errstate(over="ignore"):
        for n in range(2, max(GRAMS) + 1):
            if len(code) < n:
                break
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
            if n in GRAMS:
                marks = inner[n - 1 : len(code)] - inner[1 : len(code) - n + 2]
                out.append((mix64(h[marks == 0] + np.uint64(n)) >> np.uint64(64 - LOG2_BUCKETS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, their shares of the text's n-grams) of each text."""
    out = []
    for t in texts:
        b, n = np.unique(gram_buckets(t), return_counts=True)
        out.append((b, (n / max(1, n.sum())).astype(np.float32)))
    return out


def fit(texts: list[str], y: np.ndarray, prior: float, seed: int = SEED) -> tuple[np.ndarray, float]:
    """(number for each bucket, intercept): the score's logit is their mean over a text's n-grams plus it.

    prior: share of positive labels among all training labels. A fifth of the rows is kept from the fit;
    the intercept puts a score of one half where F1 peaks on that fifth, its classes weighted to the prior.
    With one class only, buckets are 0 and the intercept is the prior's logit.
    """
    buckets = 1 << LOG2_BUCKETS
    rng = np.random.default_rng(seed)
    aside = rng.random(len(y)) < 0.2
    if min(y[~aside].sum(), (1 - y[~aside]).sum()) < 1:
        return np.zeros(buckets, np.float32), math.log(prior / (1 - prior))
    docs, rows_in = _bags(texts), np.flatnonzero(~aside)
    vectors = rng.normal(0, 0.1, (buckets, DIMS)).astype(np.float32)
    softmax = rng.normal(0, 0.5, (DIMS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[y.astype(int)]
    share_1 = y[~aside].mean()
    weight = np.where(y == 1, 0.5 / share_1, 0.5 / (1 - share_1)).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = 1 - epoch / EPOCHS
        order = rng.permutation(rows_in)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            idx = np.concatenate([docs[i][0] for i in rows])
            share = np.concatenate([docs[i][1] for i in rows])
            own = np.repeat(np.arange(len(rows)), [len(docs[i][0]) for i in rows])
            hidden = np.column_stack([np.bincount(own, share * vectors[idx, d], len(rows)) for d in range(DIMS)]).astype(np.float32)
            z = hidden @ softmax + bias
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[rows]) * weight[rows, None]
            back = g @ softmax.T
            touched, where = np.unique(idx, return_inverse=True)
            vectors[touched] -= (RATE * rate * np.column_stack([np.bincount(where, share * back[own, d], len(touched)) for d in range(DIMS)])).astype(np.float32)
            softmax -= 0.05 * hidden.T @ g / len(rows)
            bias -= 0.05 * g.mean(0)
    weights = (vectors @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    intercept = float(bias[1] - bias[0])
    z = np.array([intercept + float((weights[b] * s).sum()) for (b, s), out in zip(docs, aside, strict=True) if out])
    return weights, intercept - _peak(z, y[aside], prior)


def _peak(z: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The logit at which F1 peaks, with classes weighted to the prior; 0 if a class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.0
    w = np.where(y == 1, prior / y.sum(), (1 - prior) / (len(y) - y.sum()))
    order = np.argsort(-z, kind="stable")
    hit, all_ = np.cumsum((w * y)[order]), np.cumsum(w[order])
    best = int(np.argmax(2 * hit / (all_ + prior)))
    return float((z[order][best] + z[order][min(best + 1, len(z) - 1)]) / 2)


def parts_of(text: str, size: int = PART):
    """A text in parts that end at white space, so that no n-gram is cut; a part is longer than `size` where its last word is."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        stop = cut.end() if cut else len(text)
        yield text[at:stop]
        at = stop


def logits(texts: list[str], weights: np.ndarray, intercept: float) -> np.ndarray:
    out = np.full(len(texts), intercept)
    for i, t in enumerate(texts):
        total, n = 0.0, 0
        for part in parts_of(t):
            b = gram_buckets(part)
            total += float(weights[b].sum(dtype=np.float64))
            n += len(b)
        if n:
            out[i] += total / n
    return out


def training_rows(df: DataFrame, labels: DataFrame, target: str, per_class: int, id_col: str, text_col: str, seed: int = SEED, most_bytes: int = SAMPLE_BYTES):
    """(texts, labels, prior) of at most per_class rows of each class and most_bytes of whole texts, chosen by hash of the id.

    An id that several rows have counts once, with the first of its texts by hash and then by code point. Texts are taken in
    order of the hash, from either class in turn, as long as they fit; one that does not fit is passed over, and so is one
    of more than 1 / LONGEST of most_bytes, so that a few long texts don't crowd out the rest.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    by_hash = lambda v: known.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
    chosen = by_hash(0).unionByName(by_hash(1))  # at most 2 * per_class ids
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(chosen), "doc_id").filter(F.octet_length("t") <= most_bytes // LONGEST)
    # Of a repeated id only hashes are compared while rows aggregate; equal hashes leave equal texts, but for collisions.
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("t", "y"), F.struct(F.xxhash64("t"), "t")).alias("r")).select("doc_id", "r.t", "r.y")
    first = written(first, "labelled")
    sizes = first.select("doc_id", "y", F.octet_length("t").alias("n"), F.xxhash64("doc_id", F.lit(seed)).alias("h")).collect()  # ids and numbers only
    place = {0: 0, 1: 0}
    order = []
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        order.append((place[r["y"]], r["h"], r["doc_id"], r["n"]))
        place[r["y"]] += 1
    taken, room = [], most_bytes
    for _, _, i, size in sorted(order):
        if size <= room:
            taken.append(i)
            room -= size
    got = first.filter(F.col("doc_id").isin(taken)).collect() if taken else []
    got.sort(key=lambda r: r["doc_id"])
    return [r["t"] for r in got], np.array([r["y"] for r in got], float), (positive + 1.0) / (n + 2.0)


def score_toxicity(df: DataFrame, labels: DataFrame, target: str = "toxic", per_class: int = PER_CLASS, threshold: float = 0.5, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Null, empty and very short texts have no n-grams and score by the intercept alone. Without usable labels
    every score is the smoothed prior. Repeated rows score alike, and a repeated id with different texts trains
    with one of them, on any rerun the same; an empty input gives an empty result.
    """
    texts, y, prior = training_rows(df, labels, target, per_class, id_col, text_col)
    weights, intercept = fit(texts, y, prior)
    model = df.sparkSession.sparkContext.broadcast((weights, intercept))  # 2^17 numbers

    def score(batches):
        import pyarrow as pa

        for b in batches:
            z = logits(["" if t is None else t for t in b.column(1).to_pylist()], *model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], ["doc_id", "score"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_toxicity(read("documents"), read("labels"))
