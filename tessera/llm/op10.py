"""Query op10_language_id and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.oracle import crc32_sql
from .common import fold
from .language_id import PROFILE, UND, learn, predict, trained_on


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, learn(trained_on(docs)))
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, text, {crc32_sql("doc_id::VARCHAR")} % 3 = 1 AS held_out FROM documents
), s AS (SELECT row, list_transform(string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g')) || ' ', ''), lambda c: unicode(c)::BIGINT) AS c FROM d WHERE regexp_matches(text, '\\p{{L}}')
), z AS (SELECT row, unnest(c) AS x, unnest(c[2:]) AS y, unnest(c[3:]) AS z FROM s
), g AS (
    SELECT row, gram, count(*) AS n FROM (
        SELECT row, x AS gram FROM z WHERE x <> 32 UNION ALL SELECT row, (x << 21) + y FROM z WHERE y IS NOT NULL UNION ALL SELECT row, (((x << 21) + y) << 21) + z FROM z WHERE z IS NOT NULL
    ) GROUP BY ALL
), profiles AS (
    SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) - 1 AS rank FROM g JOIN d USING (row) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram
    QUALIFY rank < {PROFILE}
), own AS (SELECT row, gram, row_number() OVER (PARTITION BY row ORDER BY n DESC, gram) - 1 AS rank FROM g QUALIFY rank < {PROFILE}
), size AS (SELECT row, count(*) AS n FROM own GROUP BY row
), met AS (SELECT row, lang, sum({PROFILE} - abs(p.rank - o.rank)) AS near FROM own o JOIN profiles p USING (gram) GROUP BY ALL
), every AS (SELECT row, lang, n, {PROFILE} * n - coalesce(near, 0) AS apart FROM size CROSS JOIN (SELECT DISTINCT lang FROM profiles) LEFT JOIN met USING (row, lang)
), best AS (SELECT row, lang, 1.0::DOUBLE - apart::DOUBLE / ({PROFILE} * n)::DOUBLE AS score FROM every QUALIFY row_number() OVER (PARTITION BY row ORDER BY apart, lang) = 1
)
SELECT doc_id, held_out, coalesce(best.lang, '{UND}') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (row)"""
QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL = {"op10_language_id": SQL}
