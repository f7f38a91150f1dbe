"""Where bounds bite: samples, dictionaries, repeated rows, hidden elements, very long texts and deep pages."""

import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framegrain.llm import exact_dedup, html_extract, html_model, sentencepiece, sharding, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_one_long_text_does_not_empty_the_sample(spark):
    """Whatever is first in order of the hash: a text above the bound, or many that fill it, leave room for the others."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = spark.createDataFrame([(i, f"text {i} " * 4) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    order = rows.orderBy(F.xxhash64("doc_id", F.lit(toxicity.SEED))).select("doc_id").collect()
    long = rows.withColumn("text", F.when(F.col("doc_id") == order[0].doc_id, F.repeat(F.lit("long "), 3_000)).otherwise(F.col("text")))
    texts, y, _ = toxicity.training_rows(long, labels, "toxic", 1_000, "doc_id", "text", most_bytes=20_000)
    assert len(texts) == len(ids) - 1 and 0.4 < y.mean() < 0.6
    middling = rows.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.repeat(F.lit("bulk "), 240)).otherwise(F.col("text")))
    texts, y, _ = toxicity.training_rows(middling, labels, "toxic", 1_000, "doc_id", "text", most_bytes=20_000)
    assert sum(map(len, texts)) <= 20_000 and (y == 0).sum() >= 16 and (y == 1).sum() >= 8


def test_long_texts_score_as_their_parts():
    rng = np.random.default_rng(0)
    weights = rng.standard_normal(1 << toxicity.LOG2_BUCKETS)
    text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(3_000)) + " \n x"
    whole = toxicity.gram_buckets(text)
    for size in (10, 1_000, 1 << 20):
        parts = list(toxicity.parts_of(text, size))
        assert "".join(parts) == text and sorted(np.concatenate([toxicity.gram_buckets(p) for p in parts])) == sorted(whole)
    assert toxicity.logits([text], weights, 0.5)[0] == pytest.approx(0.5 + weights[whole].mean())


def test_fifty_megabytes_are_scored():
    words = "lorem ipsum dolor sit amet " * (50 * 1024 * 1024 // 27)
    weights = np.random.default_rng(1).standard_normal(1 << toxicity.LOG2_BUCKETS)
    few = toxicity.logits(["lorem ipsum dolor sit amet " * 1_000], weights, 0.0)
    assert toxicity.logits([words], weights, 0.0)[0] == pytest.approx(few[0], abs=1e-9)


@pytest.fixture(scope="module")
def model(spark):
    return sentencepiece.read_model(spark, sentencepiece.default_model_path())


def test_the_dictionary_fills_its_room(spark, model):
    """Units that occur once enter where there is room; of units that are alike as many enter as there is room for."""
    once = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(300)))], "doc_id long, text string")
    assert sentencepiece.frequent_units(once, model, "text").count() == 300
    alike = spark.createDataFrame([(k, " ".join(f"unit{i}" for i in range(3_000))) for k in range(2)] + [(9, "top top top top")], "doc_id long, text string")
    got = {r.unit for r in sentencepiece.frequent_units(alike, model, "text", 2_000).collect()}
    assert 1_950 <= len(got) <= 2_000 and sentencepiece.MARK + "top" in got
    assert got == {r.unit for r in sentencepiece.frequent_units(alike.repartition(3), model, "text", 2_000).collect()}
    assert sentencepiece.frequent_units(alike, model, "text", 0).count() == 0
    texts = spark.createDataFrame([(1, "x" * 60 + " y")], "doc_id long, text string")
    assert [r.unit for r in sentencepiece.frequent_units(texts, model, "text").collect()] == [sentencepiece.MARK + "y"]  # longer than LONG


def test_long_texts_are_encoded_in_parts(spark, model):
    text = "  a  few words,  then\tmore ▁▁ marks \n" * 60
    marked = sentencepiece.marked(text, model)
    for size in (1, 7, 500):
        parts = list(sentencepiece.parts_of(marked, size))
        find = sentencepiece.re.compile(sentencepiece.UNIT).findall
        assert "".join(parts) == marked and [u for p in parts for u in find(p)] == find(marked)
    long = text * 1_200  # beyond two chunks
    rows = spark.createDataFrame([(1, text), (2, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepiece.round_trip(rows, model, ["doc_id"]).collect()}
    assert got[2].round_trip and got[2].n_ids > 1_000 * got[1].n_ids


def test_a_row_that_holds_a_third_of_all(spark):
    """Copies of one row, id and text, are kept once, and get as many places as they are; no task makes all of them."""
    n = 30_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(8)
    out = exact_dedup.exact_dedup(rows)
    assert out.count() == n and out.filter("kept").count() == n - n // 3 + 1 and out.filter("doc_id = -1 AND kept").count() == 1
    sharding_rows = sharding.shard(rows.withColumn("doc_id", F.when(F.col("doc_id") == -1, F.lit(-1)).otherwise(F.lit(-1) - F.col("doc_id") % 2)).withColumn("text", F.lit("a")))
    got = sharding_rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("top")).collect()
    assert sum(r.n for r in got) == n and {r.n for r in got} == {n // 24} and all(r.slots == r.n == r.top + 1 for r in got)


@pytest.mark.parametrize("hidden", html_model.HIDDEN)
def test_hidden_paragraphs_stay(spark, hidden):
    paragraphs = [f"Paragraph number {i} has words enough to be one of the text." for i in range(3)]
    body = "".join(f"<p{hidden if i == 1 else ''}>{p}</p>" for i, p in enumerate(paragraphs))
    page = f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title of it</h1>{body}</article><div class=cookie-notice{hidden}><p>We use cookies.</p></div><footer>© x</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "page_ID_")})
    assert html_extract.extract(rows).first().text == "\n".join(["Title of it", *paragraphs])


def test_deep_and_unclosed_pages_take_seconds():
    for page in ("<div class=sidebar>x" * 50_000, "<div>x" * 50_000, "<select>x" * 50_000, "<div><p>" * 30_000 + "</section>" * 30_000):
        began = time.time()
        html_extract.main_text(page)
        assert time.time() - began < 15
