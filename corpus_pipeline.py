"""The training-data pipeline: stages over ``documents``, each one applying one operator of ``hashloom.llm``.

Every stage works on all rows that its predecessor kept and hands on the columns of ``documents``; the last one
returns the packed pieces.  Rows are told apart by id and text, so null and repeated ids lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm import decontam, packing, secrets, simhash, toxicity
from hashloom.plans.hot import fresh, hinted
from hashloom.scratch import mark, materialize, sweep


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the model, fitted on the labelled ones, scores at 0.5 or more go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays."""
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a benchmark passage go."""
    key = F.xxhash64("doc_id", "text")
    leaks = decontam.find_leaks(docs.select(key.alias("key"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    (leak,) = fresh(docs.columns, "leak")
    found, _ = materialize(leaks.select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(hinted(found), key == F.col(leak), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: every reported span is replaced; ``n_chars`` follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of packed training sequences."""
    return packing.pack(docs).drop("padding", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL expresses neither the fitted model nor the tokenizer; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to shared storage and read again, its working tables and its input go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = mark()
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, since, path)
    return STAGES[-1][1](spark, docs, sf_dir)
