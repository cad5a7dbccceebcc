"""Query op1_embedding_dedup and its SQL, which compares all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import near_duplicates


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(id, c) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT links.b, reach.c FROM reach JOIN links ON reach.id = links.a AND links.b > reach.c
), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1
), c AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.id = vec_id"""
QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLE_SQL = {"op1_embedding_dedup": SQL}
