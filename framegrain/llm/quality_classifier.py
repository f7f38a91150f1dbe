"""Operator 9: a sparse rule ensemble as quality classifier.

Shallow boosted trees over whole-text statistics give candidate rules, one for each path; a logistic model
with an L1 penalty keeps a few of them with weights; the kept rules are compiled into one Spark column
expression, so scoring is a projection. Only the fit (on at most `sample` labelled rows) runs in numpy.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegrain.llm.common import SEED, crc_fold, written
from framegrain.llm.textstats import with_stats

#: Labelled rows that the fit takes at most.
SAMPLE = 6_000
TREES, DEPTH, CUTS, RATE = 24, 3, 24, 0.3
FEATURES = ("words", "word_length", "symbols", "upper", "repeats", "dup_lines", "distinct")


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return dict(zip(FEATURES, (
        F.ln(1.0 + F.col("n_words")), F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_upper") / chars,
        F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_distinct_words") / n,
    ), strict=True))


def _grow(x, g, h, rows, depth, path, rules):
    """A regression tree on gradients g and curvatures h; every node's path but the root's becomes a rule."""
    if path:
        rules.append(tuple(path))
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, None)
    if depth and len(rows) >= 20:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS))):
                left = v <= cut
                k = int(left.sum())
                if k < 5 or len(rows) - k < 5:
                    continue
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = (gain, (f, float(cut)))
    out = np.full(len(x), value)
    if best[1]:
        f, cut = best[1]
        for side in (True, False):
            mask = (x[:, f] <= cut) == side
            out[mask] = _grow(x, g, h, rows[mask[rows]], depth - 1, [*path, (f, cut, side)], rules)[mask]
    return out


def holds(rule, x: np.ndarray) -> np.ndarray:
    return np.all([(x[:, f] <= cut) == side for f, cut, side in rule], axis=0)


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, seed: int = SEED) -> tuple[float, list[tuple[float, tuple]]]:
    """(intercept, [(weight, rule)]). With one class only, the smoothed prior and no rules."""
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    base = math.log(prior / (1 - prior))
    if len(np.unique(y)) < 2:
        return base, []
    rng, z, rules = np.random.default_rng(seed), np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        z = z + RATE * _grow(x, p - y, p * (1 - p), rows, DEPTH, [], rules)
    rules = list(dict.fromkeys(rules))
    a = np.column_stack([holds(r, x) for r in rules]).astype(float)
    _, first = np.unique(a, axis=1, return_index=True)  # rules that hold for the same rows count once
    rules, a = [rules[i] for i in sorted(first)], a[:, sorted(first)]
    w, b, v, t = np.zeros(a.shape[1]), base, np.zeros(a.shape[1]), 1.0
    step = 4.0 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
    for _ in range(400):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(a @ v + b))) - y
        new = v - step * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= step * r.mean()
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(b), [(float(k), r) for k, r in zip(w, rules, strict=True) if k]


def compiled(intercept: float, rules, columns: dict[str, Column] | None = None) -> Column:
    """The score of the rules as a column expression."""
    cols = list((columns or {f: F.col(f) for f in FEATURES}).values())
    z = F.lit(intercept)
    for weight, rule in rules:
        met = F.lit(True)
        for f, cut, side in rule:
            met = met & ((cols[f] <= cut) if side else (cols[f] > cut))
        z = z + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def labelled(rows: DataFrame, labels: DataFrame, target: str, sample: int, columns: list[str], seed: int = SEED) -> DataFrame:
    """At most `sample` training rows (label not null, outside the held-out fold), chosen by hash of the id.

    An id that several rows have counts once, with the smallest of their values.
    """
    known = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max(target).alias("_y")).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    return rows.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("_y", *columns)).alias("_r")).select("doc_id", "_r.*")


def score_quality(df: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, threshold: float = 0.3, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Null and empty texts have statistics of zero and are scored like any other. Without usable labels the
    score is the smoothed prior. Repeated rows score alike and train once; an empty input gives an empty result.
    """
    rows = with_stats(df, text_col, [F.col(id_col).alias("doc_id")])
    rows = written(rows.select("doc_id", *[v.cast("double").alias(k) for k, v in features().items()]), "rules")
    train = labelled(rows, labels, target, sample, list(FEATURES)).orderBy("doc_id", *FEATURES).toPandas()
    intercept, rules = fit_rules(train[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), train["_y"].to_numpy(float))
    score = compiled(intercept, rules)
    return rows.select("doc_id", (crc_fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_quality_classifier(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score_quality(read("documents"), read("labels"))
