"""Whitening, hard negatives and licence scans against brute force."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from framegrain.llm import hard_negatives, license_scan, whitening
from framegrain.llm.vectors import whole_vectors
from tests_llm_helpers import ODD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
NAN, INF = float("nan"), float("inf")
CLASH = ("x", "dist", "block", "group", "rid", "score", "place", "los", "n", "component", "near", "anchor", "t", "label_", "v", "i")


def vector(i, d=6):
    rng = random.Random(i)
    return [round(rng.gauss(0, 1), 3) for _ in range(d)]


def odd_vectors(spark):
    """Null ids, labels, vectors and entries, NaN and infinite ones, short and empty vectors, repeated rows, one id with two vectors, ties."""
    rows = [(i, vector(i % 40), i % 3) for i in range(0, 400, 4)]
    rows += [rows[25]] * 30 + [rows[0], rows[0]] + [(1000 + i, vector(7), i % 2) for i in range(60)]
    rows += [(100, vector(5), 0), (200, vector(5), None), (300, None, 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (600, [NAN] * 6, 1), (601, [INF] + [0.0] * 5, 2)]
    rows += [(None, vector(1), 1), (None, vector(2), 1), (None, None, None), (700, [], 0), (800, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in CLASH})


def kept_vectors(df, labelled=False):
    rows = [(r.vec_id, r.label, r.embedding) for r in df.select("vec_id", "embedding", "label").collect()]
    rows = [r for r in rows if r[2] is not None and all(c is not None and math.isfinite(c) for c in r[2]) and not (labelled and r[1] is None)]
    d = max((len(r[2]) for r in rows), default=0)
    return [r for r in rows if len(r[2]) == d]


# --- 11 ----------------------------------------------------------------------------------------------------


def check_whitening(df, k=32):
    out = whitening.whiten(df, k).toPandas()
    rows = kept_vectors(df)
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r[2]] for r in rows])
    n, sums = len(x), x.sum(axis=0)
    c = (n * x - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, int((e > 1e-9 * e[0]).sum()))
    want = (c @ u[:, :k]) / np.sqrt(e[:k])
    assert len(out) == n * k and (out.n == n).all() and (out.identity_error <= 1e-9).all() and out.identity_error.nunique() == 1
    assert out.groupby("component").explained.first().to_numpy() == pytest.approx(e[:k] / e.sum())
    deviation = {}
    for (i, _, _), v in zip(rows, x.tolist(), strict=True):
        deviation.setdefault(i, []).append(sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True)))
    got = out[out.component == 1].groupby("vec_id", dropna=False).deviation.apply(list)
    assert {(None if i != i else int(i)): sorted(map(int, v)) for i, v in got.items()} == {i: sorted(v) for i, v in deviation.items()}
    gap = min(-np.diff(e[: k + 1])) / e[0] if k < len(e) else min(-np.diff(e)) / e[0] if len(e) > 1 else 1
    for j in range(k):
        mine = out[out.component == j + 1]
        key = lambda ids, values: sorted(((-1 if i is None or i != i else int(i)), round(v, 6) + 0.0) for i, v in zip(ids, values, strict=True))
        ids = [r[0] for r in rows]
        if gap > 1e-6:
            flipped = np.sign(float(np.dot(sorted(want[:, j]), sorted(mine.whitened)))) or 1
            assert any(
                all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(key(ids, want[:, j] * s), key(mine.vec_id, mine.whitened), strict=True)) for s in (flipped, -flipped)
            )
    return out


def test_whitening_of_odd_rows(spark):
    df = odd_vectors(spark)
    check_whitening(df)
    check_whitening(df.repartition(7), 2)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.filter("embedding is null")).count() == 0
    assert whitening.whiten(df.filter("vec_id = 4")).count() == 0  # one row: no variance
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    out = whitening.whiten(line).toPandas()
    assert sorted(out.component.unique()) == [1] and out.explained.iloc[0] == pytest.approx(1)
    huge = spark.createDataFrame([(i, [3e10 * i, 1.0 * (i % 2)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in whitening.whiten(huge).collect())  # beyond a long


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(df)
    x, d = whole_vectors(df, 64, 1_000_000)
    fit = whitening.principal_components(x, d, 3)
    assert fit.passes[0] == 3 + whitening.MORE_COLUMNS and (fit.residuals <= whitening.CERTAIN * 8 * fit.values[0]).all()


def test_a_block_that_need_not_grow(spark):
    """A steep spectrum converges in the first block, whose columns stay far below the dimensions."""
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    rows = (rng.standard_normal((600, 40)) * 1000.0 * 0.3 ** np.arange(40)) @ basis.T
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "vec_id long, embedding array<double>")
    x, d = whole_vectors(df, 1 << 20)
    fit = whitening.principal_components(x, d, 3)
    exact = np.array([r.x for r in x.collect()], float)
    e, u = np.linalg.eigh(np.cov(exact.T, bias=True))
    assert set(fit.passes) == {11} and fit.values == pytest.approx(e[::-1][:3], rel=1e-10)
    assert np.abs(np.abs((fit.vectors * u[:, ::-1][:, :3]).sum(axis=0)) - 1).max() < 1e-10


# --- 13 ----------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, y, tuple(math.floor(256 * float(c)) for c in v)) for i, y, v in rows}, key=repr)
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a in rows:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in rows if b is not a]
        for score, p, _ in sorted((s for s in scored if s[2] == a[1]), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != a[1] and low * score <= 100 * s[0] <= high * score), key=order)[:negatives]
            out += [(a[0], p, rank + 1, s[1], score, s[0]) for rank, s in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cut", [{}, {"block_rows": 16, "anchor_rows": 4, "pivots": 3}])
def test_hard_negatives_of_odd_rows(spark, cut):
    df = hard_negatives.relabelled(odd_vectors(spark))
    out = hard_negatives.mine(df, every=20, **cut)
    want = brute_negatives(kept_vectors(df, True), 20)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert len(want) > 100 and sorted(map(tuple, out.collect()), key=repr) == want
    if not cut:
        assert hard_negatives.mine(df.limit(0)).count() == 0 and hard_negatives.mine(df.filter("vec_id % 100 > 0")).count() == 0
        assert hard_negatives.mine(df.filter("label is null")).count() == 0
        few = df.filter("vec_id in (100, 104, 108, 112)")
        assert sorted(map(tuple, hard_negatives.mine(few).collect()), key=repr) == brute_negatives(kept_vectors(few, True))


def test_hard_negatives_of_the_table(spark):
    df = hard_negatives.relabelled(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want = brute_negatives(kept_vectors(df, True))
    assert sorted(map(tuple, hard_negatives.mine(df, block_rows=64, anchor_rows=2).collect()), key=repr) == want
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(duckdb.sql(hard_negatives.OP13_SQL).fetchall(), key=repr) == want


def test_brackets_hold_and_prune():
    """No score leaves its bracket; on clustered rows most pairs are never multiplied out."""
    rng = np.random.default_rng(3)
    y = rng.standard_normal((12, 16))[rng.integers(0, 12, 3_000)] + rng.standard_normal((3_000, 16)) * 0.02
    y = np.floor(2_048 * y / np.linalg.norm(y, axis=1)[:, None])
    q = y[::60]
    top = float((y * y).sum(axis=1).max())
    pivots = hard_negatives.choose_pivots(y[:500], top)
    dist = hard_negatives.row_distances(y, top, pivots)
    low, high = hard_negatives.brackets(q, hard_negatives.query_distances(q, top, pivots), dist, dist, top)
    score = q @ y.T
    assert (low <= score).all() and (score <= high).all()
    rows = {"x": y.astype(np.int64), "dist": dist, "label": np.arange(3_000) % 3, "rid": np.arange(3_000), "id": np.arange(3_000)}
    best = np.sort(score, axis=1)[:, -40]
    asked = {"x": q.astype(np.int64), "label": np.arange(0, 3_000, 60) % 3, "rid": np.arange(0, 3_000, 60), "los": best[:, None].astype(np.int64), "his": np.full((50, 1), 1 << 60)}
    _, pairs = hard_negatives.search_cell(asked, rows, pivots, top, True, 5)
    assert pairs < 0.4 * len(q) * len(y)


# --- 12 ----------------------------------------------------------------------------------------------------


def brute_scan(text):
    """Words by the contract's pattern; every notice by the regex library over the whole text, without pieces or windows."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = list(regex.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered))
    words = [m.group() for m in found]
    places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined, starts, at = " ".join(words), {}, 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    spans = []
    for notice in license_scan.NOTICES:
        for a, b, edits in license_scan.matches(joined, notice):
            first, last = starts[a], max(i for s, i in starts.items() if s < b)
            spans.append((notice.label, first, last - first + 1, found[first].start(), found[last].end(), edits, 1 - edits / len(notice.exact + notice.fuzzy)))
    base = {label for _, label in places}
    labels = base | {s[0] for s in spans}
    score = max([1.0] * bool(places) + [s[-1] for s in spans], default=0.0)
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(s[:-1] for s in spans)


def edited(rng, notice):
    text = list(notice.fuzzy)
    for _ in range(rng.randint(0, notice.errors + 1) if text else 0):
        at = rng.randrange(len(text))
        text[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "é", "🙂", "ab"])
    return notice.exact + "".join(text)


def noise(rng):
    return " ".join(rng.choice(["gnu", "general", "public", "license", "by", "cc", "mit", "ä", "Permission", "is", "hereby,", "0"]) for _ in range(rng.randint(0, 6)))


def licence_texts():
    rng = random.Random(4)
    out = []
    for _ in range(50):
        parts = [p for n in rng.sample(license_scan.NOTICES, 3) for p in (noise(rng), edited(rng, n))]
        joined = rng.choice([" ", "\n", " - ", "..."]).join(parts)
        out.append("".join(c.upper() if rng.random() < 0.2 else c for c in joined))
    return out


def test_license_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 500")  # the brute force is slow on long texts
    odd = spark.createDataFrame([*[r for r in ODD if len(r[1] or "") < 6_000], (20, "CC-BY cc by\0CC\nBY MIT LICENSE mit  license", None, None)], "doc_id long, text string, lang string, source string")
    drawn = spark.createDataFrame(list(enumerate(licence_texts())), "doc_id long, text string")
    for df in (docs, odd.withColumns({c: F.lit(1) for c in ("t", "n_words", "labels", "spans", "score")}), drawn):
        got = license_scan.license_scan(df).collect()
        want = sorted([(r.doc_id, *brute_scan(r.text)) for r in df.select("doc_id", "text").collect()], key=repr)
        assert sorted([(*r[:-1], sorted(map(tuple, r.spans))) for r in got], key=repr) == want
    assert license_scan.license_scan(odd.limit(0)).count() == 0
    assert sum(len(r.spans) for r in license_scan.license_scan(drawn).collect()) > 120


def test_license_base_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = license_scan.license_scan(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert sorted(tuple(r[:6]) for r in got) == sorted(duckdb.sql(license_scan.BASE_SQL).fetchall())


def test_license_in_a_very_long_text():
    """30 MB: the places far inside are right, in words and in code points."""
    filler = "wörd 12 " * 2_000_000
    text = f"{filler}MIT License {filler}Apach licence, v2 "
    n_words, n_base, first, last, base, labels, score, spans = license_scan.scan(text.encode())
    assert (n_words, n_base, first, last, base, score) == (8_000_005, 1, 4_000_000, 4_000_000, "mit", 1.0)
    assert [text[s["start"] : s["stop"]] for s in spans] == ["MIT License"] and spans[0]["start"] == len(filler)
    assert labels == "mit"  # two edits are one too many for the other
