"""Similarity tables written by pairwise or multisearch, as input of cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = {
    "query_name": "string", "query_md5": "string", "match_name": "string", "match_md5": "string", "containment": "double", "max_containment": "double", "jaccard": "double",
    "average_containment": "double", "intersect_hashes": "double", "ksize": "int", "scaled": "int", "moltype": "string",
}
OPTIONAL = {
    "cosine": "double", "query_containment_ani": "double", "match_containment_ani": "double", "average_containment_ani": "double", "max_containment_ani": "double",
    "prob_overlap": "double", "prob_overlap_adjusted": "double", "containment_adjusted": "double", "containment_adjusted_log10": "double", "tf_idf_score": "double",
}


def read_similarities(spark: SparkSession, path: str) -> DataFrame:
    """Columns by name in any order; a missing required column or a value of the wrong kind is an error."""
    table = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [c for c in REQUIRED if c not in table.columns]
    if missing:
        raise ValueError(f"missing column '{missing[0]}' in {path}")
    return table.select(*[F.col(c).cast(t).alias(c) for c, t in (REQUIRED | OPTIONAL).items() if c in table.columns])
