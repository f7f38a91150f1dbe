"""The corpus pipeline: raw documents to token ids of a deduplicated, filtered mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes what a stage returns as Parquet
and rereads it for the next one. All stages but the last return the columns of docs. Rows are judged on the
stage's own input: null and empty texts fall to the quality rules, repeated rows to exact deduplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framegrain.llm.common import WRITTEN, drop_written, written
from framegrain.llm.exact_dedup import exact_dedup, normalised
from framegrain.llm.jaccard_join import jaccard_join, row_keys
from framegrain.llm.mixing import mix
from framegrain.llm.quality_rules import quality_rules
from framegrain.llm.sentencepiece import default_model_path, read_model, round_trip


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of docs has, whatever the case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def _packed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with each whole row in one more column, and that column's name: operators carry it along."""
    (name,) = _fresh(docs, "_row")
    return docs.withColumn(name, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), name


def _only(docs: DataFrame, keys: list, names: DataFrame) -> DataFrame:
    """One row of docs for each row of names, which has the columns k1 and k2; keys are their values in docs.

    Of several rows with one key the first in order of its columns stays, so reruns keep the same one; columns that
    have no order (maps, variants) don't count.
    """
    a, b, row = _fresh(docs, "_k1", "_k2", "_whole")
    names = names.select(F.col("k1").alias(a), F.col("k2").alias(b))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    found = docs.withColumns({a: keys[0], b: keys[1]}).join(names, [a, b], "left_semi")
    return found.groupBy(a, b).agg(F.min_by(whole, F.struct(F.xxhash64(*ordered), *ordered)).alias(row)).select(f"{row}.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the rules reject go."""
    rows, name = _packed(docs)
    return quality_rules(rows, keep=(name,)).filter("kept").select(f"{name}.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of equal texts the row with the largest doc_id stays."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    names = exact_dedup(docs).filter("kept").select(F.col("text_sha256").alias("k1"), name.alias("k2"))
    return _only(docs, [F.sha2(normalised(F.col("text")), 256), name], names)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near-duplicates one document stays."""
    names = jaccard_join(docs).filter("kept").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"))
    return _only(docs, row_keys(F.col("doc_id"), F.col("text")), names)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: each document as often as the mixture takes it."""
    rows, name = _packed(docs)
    out = mix(rows, keep=(name,)).filter("copies > 0")
    return out.select(name, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select(f"{name}.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token ids, and whether decoding them gives the text back."""
    model = read_model(spark, default_model_path())
    return round_trip(docs, model, ["doc_id", "source"])


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can express neither the robust distances nor the MinHash groups nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(WRITTEN)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, begun, keep=1)  # the stage's result is written: its own tables and the one before it are done with
    return STAGES[-1][1](spark, docs, sf_dir)
