"""Query op3_quality. A fitted model can't be said in SQL; tests measure held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold
from .quality import CUT, sampled, score, train


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = score(docs, train(sampled(docs, labels, "quality", 5, 0)))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLE_SQL: dict[str, str] = {}
