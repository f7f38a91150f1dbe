"""Training-data operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrain.llm import exact_dedup, html_extract, html_model, jaccard_join, mixing, quality_classifier, quality_rules, sentencepiece, sharding, suffix_dedup, toxicity
from framegrain.llm.common import bloom_bits, bloom_hit, shingle_sets
from framegrain.llm.graph import connected_components
from tests_llm_helpers import ODD, base_stats, lowered, near_groups, words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")

@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(1) for c in ("node", "d1", "d", "key", "size", "n", "g", "r", "best", "kept", "k1", "_k1", "_row", "copies", "n_words", "ids", "weight", "bin", "row", "unit", "t")}
    return rows.withColumns(clash)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- 1 -----------------------------------------------------------------------------------------------------


def fair_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = left / sum(w[s] for s in free)
        full = {s for s in free if share * w[s] > 2 * sizes[s]}
        if not full:
            target |= {s: share * w[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def test_mixing(spark, odd, empty, docs):
    for df in (docs, odd):
        out = mixing.mix(df).collect()
        assert len(out) == df.count()
        sizes = collections.Counter()
        for r in df.select("text", "source").collect():
            sizes[r.source] += len(words(r.text))
        want = fair_targets(sizes)
        for s in sizes:
            mine = [r for r in out if r.source == s]
            assert {r.source_size for r in mine} == {sizes[s]} and all(r.target == pytest.approx(want[s]) for r in mine)
            assert abs(sum(r.taken for r in mine) - want[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
            assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
            epochs = math.floor(want[s] / sizes[s] + 1e-12) if sizes[s] else 0
            assert all(r.copies >= epochs for r in mine if r["size"])
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0


def test_mixing_in_narrow_ranges(spark):
    """Low weights, a repeated row with a third of a source, and last ranges of few rows: the same as one sort."""
    rows = [(i, "w " * (1 + i % 7) + ("# " * 40 if i % 3 else ""), f"s{i % 2}") for i in range(400)] + [(7, "same words here", "s1")] * 150 + [(9, "", "s0")] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df, edge_rows=4).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df).collect()))
    for s in ("s0", "s1"):
        mine = sorted((r for r in got if r.source == s), key=lambda r: (mixing_key(r.doc_id, next(t for i, t, c in rows if (i, c) == (r.doc_id, s) and len(words(t)) == r["size"])), r.doc_id, r["size"], -r.copies))
        budget, epochs, before = mine[0].target - mine[0].source_size * (mine[0].target // mine[0].source_size), mine[0].target // mine[0].source_size, 0
        for r in mine:
            assert r.copies == (epochs + (2 * before + r["size"] <= 2 * budget) if r["size"] else 0)
            before += r["size"]


def mixing_key(doc_id, text):
    u = (int(hashlib.md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / (max(0.05, sum(c not in mixing._NOISE for c in text) / len(text)) if text else 1.0)


# --- 2 -----------------------------------------------------------------------------------------------------


def near_copies():
    rng = np.random.default_rng(4)
    base = [f"t{i}" for i in range(200)]
    out = []
    for k in range(60):
        t = list(base)
        for at in rng.integers(0, 200, k % 9):
            t[at] = f"e{k}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("tile", [1_500, 16])
def test_jaccard_join(spark, odd, docs, tile):
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(near_copies())], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionByName(extra), odd):
        rows = df.select("doc_id", "text").collect()
        links, roots = near_groups([r.text for r in rows])
        least = {}
        for r, x in zip(rows, roots):
            least[x] = min((v for v in (least.get(x), r.doc_id) if v is not None), default=None)
        want = sorted(repr((r.doc_id, least[x], n)) for r, x, n in zip(rows, roots, links))
        out = jaccard_join.jaccard_join(df, tile=tile).collect()
        assert sorted(repr((r.doc_id, r.class_id, r.links)) for r in out) == want
        assert sum(r.kept for r in out) == len(set(roots))


def test_components_with_hubs(spark, monkeypatch):
    """A star, a chain and a clique beside single edges, with hubs met by broadcast and by shuffle."""
    from framegrain.llm import graph

    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1_000, 1_040)] + [(i, j) for i in range(2_000, 2_012) for j in range(i)if j >= 2_000] + [(i, i + 1) for i in range(5_000, 5_200, 2)] + [(7, 7)]
    want = {n: (0 if n < 300 else 1_000 if n < 1_041 else 2_000 if n < 2_012 else n - n % 2) for p in pairs for n in p}
    for share in (4, 2_000):
        monkeypatch.setattr(graph, "HUB_SHARE", share)
        edges = spark.createDataFrame(pairs, "a long, b long")
        assert {r.node: r.component for r in connected_components(edges).collect()} == want
    assert connected_components(edges.limit(0)).count() == 0


def test_jaccard_parts(spark, empty):
    assert jaccard_join.jaccard_join(empty).count() == 0
    least = jaccard_join.least_matches(0.8, 1e-7)
    assert least == sorted(least) and all(m < 0.8 * 32 * (k + 1) for k, m in enumerate(least))
    a, b = shingle_sets([b"a b c d e f g h i j", b"a b c d e f g h i k"])
    assert len(a) == len(b) == 6 and len(np.intersect1d(a, b)) == 5
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    bits = bloom_bits(spark.range(1000).select((F.col("id") * 7919).alias("k")), 16)
    assert bloom_hit(bits, np.arange(1000) * 7919, 16).all() and bloom_hit(bits, np.arange(1000) * 7919 + 3, 16).mean() < 0.1


# --- 3 -----------------------------------------------------------------------------------------------------


def repeats(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "length", "gram"), [(100_000, 24, 8), (3, 24, 8), (100_000, 40, 16)])
def test_suffix_dedup(spark, hot, length, gram):
    rng = np.random.default_rng(5)
    base = [bytes(rng.integers(97, 100, 60, dtype=np.uint8)) for _ in range(6)]
    texts = []
    for i in range(80):
        t = b"".join(base[rng.integers(0, 6)][slice(*sorted(rng.integers(0, 60, 2)))] + bytes(rng.integers(97, 123, rng.integers(0, 30), dtype=np.uint8)) for _ in range(rng.integers(0, 6)))
        texts.append(b"abc" * int(rng.integers(0, 80)) if i % 17 == 0 else t)
    rows = [(i, t.decode()) for i, t in enumerate([*texts, texts[3], texts[5]])] + [(5, texts[5].decode()), (None, None), (None, texts[7].decode())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, length, gram, 50, hot).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(repeats([(t or "").encode() for _, t in rows], length))


def test_windows_with_colliding_hashes(monkeypatch):
    """Repeats inside a text are settled by bytes, also where all hashes collide."""
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(97, 99, 300, dtype=np.uint8)) + b"ab" * 60 + b"a" * 40
    exact = [text[i : i + 12] for i in range(len(text) - 11)]
    whole = suffix_dedup.anchors([text], 12, 4)
    honest = suffix_dedup._window_hashes
    for mask in (2**64 - 1, 7, 0):
        monkeypatch.setattr(suffix_dedup, "_window_hashes", lambda buf, length, mask=mask: honest(buf, length) & np.uint64(mask))
        got = suffix_dedup.window_classes(text, 12).tolist()
        assert len(set(zip(got, exact))) == len(set(got)) == len(set(exact))
        assert repr(suffix_dedup.anchors([text], 12, 4)) == repr(whole)


def test_suffix_dedup_tables(odd, empty, docs):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        want = sorted((repr(r.doc_id), *x) for r, x in zip(rows, repeats([(r.text or "").encode() for r in rows], 400)))
        assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_loser_tree():
    rng = np.random.default_rng(1)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12), dtype=np.uint8)) for _ in range(rng.integers(0, 30))) for _ in range(7)]
    got = list(suffix_dedup.merged([suffix_dedup.front_coded(r) for r in runs]))
    strings = [runs[r][i] for r, i, _ in got]
    assert strings == sorted(s for r in runs for s in r)
    assert [p for _, _, p in got][1:] == [suffix_dedup.common_prefix(a, b) for a, b in zip(strings[:-1], strings[1:])]


def test_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    t = bytes(rng.integers(97, 123, 3_000, dtype=np.uint8))
    whole = suffix_dedup.anchors([t, b"short"], 400, 64)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_000)
    pieces = suffix_dedup.anchors([t, b"short"], 400, 64)
    owners = lambda x: {i: int(a) for a, s, e in zip(x[2], x[3], x[4]) for i in range(s, e + 1)}
    assert owners(whole) == owners(pieces) and len(owners(whole)) == 2_601


# --- 4 -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest_bytes", [32, 1])
@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_dedup(odd, docs, keep, digest_bytes):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        groups = collections.defaultdict(list)
        for r in rows:
            groups[lowered(r.text)].append(r.doc_id)
        pick = lambda ids: (max if keep == "max" else min)((i for i in ids if i is not None), default=None)
        want = sorted(repr((r.doc_id, pick(groups[lowered(r.text)]), len(groups[lowered(r.text)]), hashlib.sha256(lowered(r.text)).hexdigest())) for r in rows)
        out = exact_dedup.exact_dedup(df, keep, digest_bytes).collect()
        assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in out) == want
        kept = [r for r in out if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_memtables(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    rows = spark.range(0, 5_000, 1, 3).select((F.col("id") % 700).alias("d"), F.col("id").alias("r")).withColumn("d", F.unhex(F.sha2(F.col("d").cast("string"), 256)))
    runs = exact_dedup.flushed_runs(rows, 4, memtable_rows=500)
    assert runs.count() == 12
    index = exact_dedup.compacted(runs, 32)
    assert index.count() == 700 and index.agg(F.sum("n")).first()[0] == 5_000 and index.agg(F.max("best")).first()[0] == 699


# --- 5 and 9 -----------------------------------------------------------------------------------------------


def test_quality_rules(odd, empty, docs):
    for df in (odd, docs):
        rows = df.select("doc_id", "text").collect()
        out = quality_rules.quality_rules(df)
        want = []
        for r in rows:
            s = base_stats(r.text)
            want.append(repr((r.doc_id, *s, s[0] < 10 or 100 * s[4] > 20 * s[0])))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        got = out.collect()
        assert sorted(repr((r.doc_id, *[r[n] for n in names])) for r in got) == sorted(want)
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_of_small_groups(spark):
    """A source of three rows is estimated by itself, and so is one of a single row."""
    plain = " ".join(f"word{i}" for i in range(40))
    odd_one = " ".join(f"#${i}%&|" for i in range(40))
    rows = [(1, plain, "en", "three"), (2, plain + " more", "en", "three"), (3, odd_one, "en", "three"), (4, odd_one, "en", "alone"), (5, odd_one, "en", "pair"), (6, odd_one + " x", "en", "pair")]
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert out == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_robust_distances(spark):
    """Centre, scatter and verdicts of one group against the same steps in numpy."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 5)) @ rng.normal(0, 0.5, (5, 5)) + 4
    x[:60] += 9  # outliers
    q = np.rint(x * 1024).astype(int)
    axes = quality_rules.AXES
    df = spark.createDataFrame([("g", *map(int, r)) for r in q], "g string, " + ", ".join(f"x_{a} long" for a in axes))
    got = {tuple(r[f"x_{a}"] for a in axes): r.d2 for r in quality_rules._measured(df, quality_rules.robust_parameters(df), 1).collect()}
    v, floors = q / 1024, np.array([quality_rules.FLOORS[a] for a in axes])
    med = np.median(v, 0)
    d2 = (((v - med) / np.maximum(floors, 1.4826 * np.median(np.abs(v - med), 0))) ** 2).sum(1)
    for _ in range(quality_rules.STEPS):
        grade = np.floor(64 * np.log1p(d2))
        core = v[grade <= np.percentile(grade, 75)]
        cov = quality_rules.CONSISTENCY * np.cov(core.T, bias=True) + np.diag(floors**2)
        z = v - core.mean(0)
        d2 = (z * np.linalg.solve(cov, z.T).T).sum(1)
    assert all(got[tuple(a)] == pytest.approx(b, rel=1e-6) for a, b in zip(q.tolist(), d2))
    assert (d2[:60] > quality_rules.CUTOFF).all() and (d2[60:] < quality_rules.CUTOFF).mean() > 0.99


def held_out(df, labels, target):
    rows = df.join(labels.select("doc_id", target), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return [(r[target], r.predicted) for r in rows if r.held_out]


def test_quality_classifier(spark, odd, empty):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    pairs = held_out(quality_classifier.score_quality(read("documents"), read("labels")), read("labels"), "quality")
    assert len(pairs) > 40 and np.mean([a == b for a, b in pairs]) > 0.95
    out = quality_classifier.score_quality(odd, read("labels").limit(0)).collect()
    assert len(out) == len(ODD) and {r.score for r in out} == {0.5}
    assert quality_classifier.score_quality(empty, read("labels").limit(5)).count() == 0


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_classifier.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    intercept, rules = quality_classifier.fit_rules(x, y)
    z = intercept + sum(w * quality_classifier.holds(r, x) for w, r in rules)
    assert np.mean((z > 0) == y) > 0.9
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], ", ".join(f"{f} double" for f in quality_classifier.FEATURES))
    assert [r[0] for r in df.select(quality_classifier.compiled(intercept, rules)).collect()] == pytest.approx(list(1 / (1 + np.exp(-z[:50]))))


# --- 6 -----------------------------------------------------------------------------------------------------


def test_sharding(spark, odd, empty, docs):
    for df, shards in ((docs, 24), (odd, 5)):
        n = df.count()
        out = sharding.shard(df, shards).collect()
        assert sorted(r["row"] for r in out) == list(range(n))
        slots = collections.defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(len(slots[k]) for k in range(shards)) <= 1
        back = spark.createDataFrame([(r["row"], r.slot * shards + r.shard) for r in out], "row long, place long").select("row", sharding.restored(F.col("place"), n).alias("b"))
        assert all(r["row"] == r.b for r in back.collect())
        want = sorted(repr((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))) for r in df.select("doc_id", "text").collect())
        assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in out) == want
    assert sorted(map(repr, out)) == sorted(map(repr, sharding.shard(odd.repartition(7), 5).collect()))
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1025])
def test_permutation(spark, n):
    out = spark.range(n).select(sharding.permuted(F.col("id"), n).alias("p"), "id").withColumn("b", sharding.restored(F.col("p"), n)).collect()
    assert sorted(r.p for r in out) == list(range(n)) and all(r.b == r.id for r in out)


# --- 7 -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    return sentencepiece.read_model(spark, sentencepiece.default_model_path())


def test_encoding_matches_library(spark, docs, odd, empty, model):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.default_model_path().removeprefix("file://"))
    for df in (docs, odd):
        out = sentencepiece.decode(sentencepiece.encode(df.select("doc_id", "text"), model), model).collect()
        assert len(out) == df.count()
        for r in out:
            assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "").replace("▁", " ")
        joined = sentencepiece.encode_relational(df.select("doc_id", "text"), model).collect()
        assert sorted(map(repr, joined)) == sorted(map(repr, sentencepiece.encode(df.select("doc_id", "text"), model).collect()))
    assert sentencepiece.encode(empty, model).count() == 0
    assert sentencepiece.encode(odd, model).columns.count("ids") == 1


def test_frequent_units(spark, model):
    """As many of the most frequent units as the dictionary holds."""
    df = spark.createDataFrame([(" ".join(f"word{i}" for i in range(60) for _ in range(1 + i)),)], "text string")
    for most, want in ((1_000, 60), (10, 10), (0, 0)):
        got = {int(r.unit.removeprefix("▁word")) for r in sentencepiece.frequent_units(df, model, "text", most).collect()}
        assert want - 1 <= len(got) <= max(want, 0) and got == set(range(60 - len(got), 60))
    assert sentencepiece.frequent_units(df.limit(0), model, "text").count() == 0


def best_path(unit, usable, penalty):
    """Highest total score by trying all paths."""
    if not unit:
        return 0.0
    scores = []
    for j in range(1, len(unit) + 1):
        s = usable[unit[:j]][1] if unit[:j] in usable else penalty if j == 1 else None
        if s is not None:
            scores.append(s + best_path(unit[j:], usable, penalty))
    return max(scores)


def test_lattices(spark, docs, model):
    units = sorted({u for r in docs.limit(20).collect() for u in re.findall(sentencepiece.UNIT, sentencepiece.marked(r.text, model)) if len(u) <= 40})[:600] + ["▁𓂀é"]
    table = spark.createDataFrame([(u,) for u in units], "unit string")
    merges = {r.unit: r.ids for r in sentencepiece.lattice_ids(table, model).collect()}
    fold = sentencepiece.Units(model, {})
    assert set(merges) == set(units) and all(merges[u] == np.frombuffer(fold[u], "<i4").tolist() for u in units)
    many = sentencepiece.merge_many(units, sentencepiece.merge_table(model))
    assert all(many[u] == fold[u] for u in many) and set(units) - set(many) == {u for u in units if any(p not in fold.usable for p in sentencepiece.merge_fold(u, fold.score))}
    unigram = model._replace(unigram=True)
    paths = {r.unit: r.ids for r in sentencepiece.lattice_ids(table, unigram).collect()}
    fold = sentencepiece.Units(unigram, {})
    usable = model.usable()
    for u in units:
        assert paths[u] == np.frombuffer(fold[u], "<i4").tolist()
        if len(u) <= 9:
            parts = sentencepiece.viterbi_fold(u, usable, fold.longest, fold.penalty)
            assert sum(usable[p][1] if p in usable else fold.penalty for p in parts) == pytest.approx(best_path(u, usable, fold.penalty))
    assert sentencepiece._heap_fold(list("▁aaaabcabcaaa" * 9), fold.score) == _slow_merges(list("▁aaaabcabcaaa" * 9), usable)


def _slow_merges(parts, usable):
    while True:
        found = [(-usable[a + b][1], k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:])) if a + b in usable]
        if not found:
            return parts
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


# --- 8 -----------------------------------------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    out = toxicity.score_toxicity(read("documents"), read("labels"))
    assert out.filter("score < 0 or score > 1").isEmpty()
    pairs = held_out(out, read("labels"), "toxic")
    found, clean = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    assert len(found) > 50 and np.mean(found) > 0.8 and np.mean(clean) < 0.1
    rows = toxicity.score_toxicity(odd, read("labels").limit(0)).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}
    assert toxicity.score_toxicity(empty, read("labels")).count() == 0


def test_training_rows_of_repeated_ids(spark):
    """A labelled id that holds most rows trains once, with the same text on any partitioning, within the bytes allowed."""
    texts = [f"text {i} of an id that is often repeated" for i in range(40)]
    rows = [(1, t) for t in texts] + [(i, f"other text {i}") for i in range(2, 40)] + [(50, "x" * 5_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in (*range(1, 40), 50)] + [(1, 1)] * 5, "doc_id long, toxic int")
    got = [toxicity.training_rows(spark.createDataFrame(r, "doc_id long, text string").repartition(k), labels, "toxic", 100, "doc_id", "text", most_bytes=100_000) for r, k in ((rows, 1), (rows[::-1], 7))]
    assert got[0][0] == got[1][0] and len(got[0][0]) == len(set(got[0][0])) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (*range(1, 40), 50))
    few, y, _ = toxicity.training_rows(spark.createDataFrame(rows, "doc_id long, text string"), labels, "toxic", 100, "doc_id", "text", most_bytes=300)
    assert sum(len(t) for t in few) <= 300 and len(few) == len(y)
    stats = spark.createDataFrame([(1, float(i)) for i in range(40)] + [(2, 1.0)], "doc_id long, v double")
    assert sorted(map(tuple, quality_classifier.labelled(stats, labels, "toxic", 10, ["v"]).collect())) in ([(1, 1, 0.0), (2, 0, 1.0)], [(1, 1, 0.0)], [(2, 0, 1.0)], [])


def test_unseen_misspellings():
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    bad = ["vermillion", "zwieback", "quixotic"]
    texts, y = [], []
    for i in range(600):
        w = list(rng.choice(plain, 60))
        if i % 2:
            for b in bad:
                w[rng.integers(0, 60)] = b
        texts.append(" ".join(w))
        y.append(i % 2)
    weights, intercept = toxicity.fit(texts, np.array(y, float), 0.5)
    test = [" ".join([*rng.choice(plain, 57), *x]) for x in ([], ["vermilion", "zwiebak", "quixotik"])]
    z = toxicity.logits(test, weights, intercept)
    assert z[0] < 0 < z[1]
    assert len(toxicity.gram_buckets("")) == 0 and toxicity.logits([""], weights, intercept)[0] == intercept


# --- 10 ----------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="<p>no</p>";</script></head><body>
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site to make it better, and you agree to that by reading on here.</p></div>
<article class=post><h1>The &amp; title</h1><p>First <b>paragraph</b> with
   white&nbsp;space, enough words to look like a text that somebody wrote.<br>Still the same.</p><p>Short one.<p>Unclosed and
followed &lt;here&gt;.</p><ul><li>A list item that belongs to the text.</li></ul><aside>Related: <a href=x>other story</a></aside>
<div class="ad">Buy now, this is a long advert with many words that goes on and on and ends with a full stop.</div></article>
<section id="comments"><p>I am a reader and this is my comment about the article, which I liked a lot.</p></section>
<form><label>Name</label><input name=q><button>Send</button></form><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_extraction(spark, empty):
    want = "The & title\nFirst paragraph with white space, enough words to look like a text that somebody wrote. Still the same.\nShort one.\nUnclosed and followed <here>.\nA list item that belongs to the text."
    assert html_extract.main_text(PAGE) == want
    rows = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<p>"), (4, None, "<script>x"), (5, "u", "<div><p>" * 300 + "deep text of some words that ends here." + "<b"), (6, "u", "a < b & c")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = {(r.page_id, r.text, r.n_chars) for r in html_extract.extract(rows).collect()}
    assert out == {(1, want, len(want)), (None, "", 0), (2, "", 0), (3, "", 0), (4, "", 0), (5, "deep text of some words that ends here.", 39), (6, "a < b & c", 9)}
    assert html_extract.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", [
    '<body class="single-post right-sidebar"><article>%s</article>', '<body><article class="post comments-open">%s</article>', '<body><article class="has-sidebar">%s</article>',
    '<body><main id="content" class="social-enabled">%s</main>', '<body><div id="page-search-results"><article>%s</article></div>',
    '<body><div class="page with-sidebar"><div>%s</div></div>', '<body><div title="hidden gems" data-class="ad"><article>%s</article></div>',
])
def test_extraction_under_wrappers_with_side_words(wrapper):
    text = ["The title", "First paragraph with enough words to look like a text that somebody wrote, and more of them than twenty in all.", "A short one.", "Another paragraph, which says a few things more about the matter."]
    body = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
    side = '<nav><a href=/>Home</a></nav><section id="comments"><div><ol><li><div><article class="comment-body"><p>I am a reader and this is my comment about it.</p></article></div></li></ol></div></section>'
    side += '<div class="sidebar"><div><div><div><p>Popular stories of this week are listed here.</p></div></div></div></div>'
    assert html_extract.main_text("<html>" + wrapper % body + side + "</body></html>") == "\n".join(text)


def test_extraction_beside_long_sides():
    long = "Buy now, this advert has many words and goes on and on, and it ends here. " * 6
    for side in (f'<div class="ad">{long}</div>', f'<section id="comments"><article><p>{long}</p></article></section>'):
        assert html_extract.main_text(f"<body><article><p>Short article text here.</p></article>{side}</body>") == "Short article text here."
    body = "".join(f"<p>Paragraph number {i} with enough words to look like a text that somebody wrote.</p>" for i in range(12))
    assert html_extract.main_text(f'<body><div class="page social"><div>{body}</div></div></body>').count("Paragraph") == 12


def test_extraction_drops_only_what_is_no_text():
    long = "This paragraph has enough words to look like a text that somebody wrote, and it ends here."
    page = f"""<body><nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>See <math><mi>x</mi>+1</math> and <svg><text>a drawing</text></svg> now.</p><p>{long}</p>
    <div class="entry-comments-guide"><p>{long} First.</p></div><div id="post-notice-board"><p>{long} Second.</p><p>Short.</p></div><noscript><p>Without scripts too.</p></noscript><p>Press <button>go</button> to start.</p>
    <p>Tail<textarea>typed</textarea> of the <object>thing</object> end.</p></article><form><p>Your name please.</p><button>Send</button></form><footer>© 2024 Site</footer></body>"""
    want = ["Title of it", "See x+1 and a drawing now.", long, f"{long} First.", f"{long} Second.", "Short.", "Without scripts too.", "Press go to start.", "Tail of the thing end."]
    assert html_extract.main_text(page) == "\n".join(want)
    for broken in ("<p>Some words here, then an open tag.</p><a href='x", "<p>Some words here, then an open tag.</p><b", "<p>Some words here, then an open tag.<!-- x"):
        assert html_extract.main_text(broken) == "Some words here, then an open tag."


def test_cut_mends_what_the_classifier_gets_wrong():
    """On drawn pages that no fit has seen, the cut changes verdicts and leaves fewer wrong ones."""
    model, pages = html_model.fitted(), html_model.drawn(200, 77)
    n = sum(len(y) for _, y in pages)
    alone, cut = html_model.errors(pages, model.weights, [(0.0, 0.0, 0.5), model.edges])
    assert cut < alone and cut < 0.01 * n
    changed = sum(a != b for found, _ in pages for a, b in zip(html_extract.labelled(found, model), html_extract.labelled(found, html_model.Model(model.weights, (0.0, 0.0, 0.5)))))
    assert changed > 10


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(7)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        cost = [float(c) for c in rng.normal(0, 1.2, n)]
        found = [html_extract.Block("", np.zeros(1), int(p), int(k)) for p, k in zip(rng.integers(0, 3, n), rng.integers(2, 6, n))]
        edges = html_extract.smoothness(found, 0.7, 0.8, 0.6)
        value = lambda keep: sum(c for c, k in zip(cost, keep) if k and c > 0) + sum(-c for c, k in zip(cost, keep) if not k and c < 0) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(value([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert value(html_extract.minimum_cut(cost, edges)) == pytest.approx(best, abs=1e-9)
