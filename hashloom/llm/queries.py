"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm import decontam, langid, lattice, packing, pivots, records, secrets, simhash, toxicity, urlfilter
from hashloom.scratch import new_path
from hashloom.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op2_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_table(spark, sf_dir, "documents"), _remainder(10) == 0)


def op4_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages"))


def op5_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _held_out(n: int, k: int) -> Column:
    return F.coalesce(_remainder(n) == k, F.lit(False))


def op6_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(_remainder(3) != 1))
    return langid.predict(docs, *model).select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score")


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents")).drop("padding", "ids")


def op8_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").filter(_remainder(5) != 0))
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "records")
    records.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return records.read(spark, path, with_ids=False).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_linked_secrets": op2_linked_secrets,
    "op3_subword_lattice": op3_subword_lattice,
    "op4_url_automaton": op4_url_automaton,
    "op5_pivot_top_k": op5_pivot_top_k,
    "op6_language_bayes": op6_language_bayes,
    "op7_sum_of_squares_packing": op7_sum_of_squares_packing,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op9_levenshtein_toxicity": op9_levenshtein_toxicity,
    "op10_binary_records": op10_binary_records,
}

ORACLES: dict[str, str] = {"op2_linked_secrets": secrets.oracle_sql(), "op4_url_automaton": urlfilter.oracle_sql(), "op5_pivot_top_k": pivots.ORACLE}
