"""Query op7_packing. Tokenising can't be said in SQL; tests check the exact round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .packing import pack


def vocabulary() -> str:
    """The vocabulary file's path, on whichever worker asks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary)


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
