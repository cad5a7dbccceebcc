"""Query op2_lm_score. Sums of logarithms differ in their last digits by order, so no SQL; tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import fold
from .kneser_ney import score, train


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, train(docs.where(fold("doc_id", 5) != 1)))
    return out.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op2_lm_score": op2_lm_score}
ORACLE_SQL: dict[str, str] = {}
