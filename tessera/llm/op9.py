"""Query op9_url_filter and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import LEAST_WEIGHT, MOST_WEIGHT, SECOND_LEVEL, THRESHOLD, WIDTH, host_of, judge

#: The rules, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the quality label of the document that a page's url numbers (its last path number)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    numbered = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"/(\d{1,18})(?:[^/\d?#][^/?#]*)?/?(?:[?#].*)?$", 1).try_cast("bigint").alias("doc_id"))
    outcomes = numbered.where("doc_id is not null").join(labels, "doc_id").select("host", F.col("quality").alias("good"))
    return judge(pages, outcomes, RULES)


def _sql() -> str:
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    fits = "\n".join(f"    SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p" + (" UNION ALL" if i < len(RULES) - 1 else "") for i, (v, h, p) in enumerate(RULES))
    weight = f"least(greatest(coalesce(CASE WHEN k > 1 AND s > ss / s AND (pp - s*m*m - (k-1)*m*(1-m)) / (s - ss/s) > 0 THEN m*(1-m) / ((pp - s*m*m - (k-1)*m*(1-m)) / (s - ss/s)) - 1 END, {MOST_WEIGHT}), {LEAST_WEIGHT}), {MOST_WEIGHT})"
    stats = "count(*)::DOUBLE AS k, sum(good) / sum(n) AS m, sum(n)::DOUBLE AS s, sum(n*n)::DOUBLE AS ss, sum(n * (good/n) * (good/n)) AS pp"
    upper = f"a/(a+b) + {WIDTH} * sqrt((a/(a+b)) * (1 - a/(a+b)) / (a+b+1))"
    return f"""
WITH p0 AS (
    SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), named AS (
    SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM p0
), parts AS (SELECT host, bare, string_split(bare, '.') AS l FROM named
), hd AS (
    SELECT host, CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM parts
), hds AS (SELECT host, domain, regexp_replace(domain, '^[^.]*\\.', '') AS suffix FROM hd
), outcomes AS (
    SELECT host, quality::DOUBLE AS good FROM p0 JOIN labels ON doc_id = try_cast(regexp_extract(url, '/([0-9]{{1,18}})(?:[^/0-9?#][^/?#]*)?/?(?:[?#].*)?$', 1) AS BIGINT) WHERE quality IS NOT NULL
), hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS good FROM outcomes JOIN hds USING (host) GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), corpus AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM hosts
), hw AS (SELECT {weight} AS w FROM (SELECT {stats} FROM hosts)
), dw AS (SELECT {weight} AS w FROM (SELECT {stats} FROM domains)
), sw AS (SELECT {weight} AS w FROM (SELECT {stats} FROM suffixes)
), sp AS (SELECT suffix, w * mean + good AS a, w * (1 - mean) + n - good AS b FROM suffixes, corpus, sw
), dp AS (SELECT domain, w * (sp.a/(sp.a+sp.b)) + good AS a, w * (1 - sp.a/(sp.a+sp.b)) + n - good AS b FROM domains JOIN sp USING (suffix), dw
), hp AS (SELECT host, w * (dp.a/(dp.a+dp.b)) + good AS a, w * (1 - dp.a/(dp.a+dp.b)) + n - good AS b FROM hosts JOIN dp USING (domain), hw
), cp AS (SELECT mean * {LEAST_WEIGHT} AS a, (1 - mean) * {LEAST_WEIGHT} AS b FROM corpus
), verdicts AS (
    SELECT hds.host, coalesce(h.u, d.u, s.u, c.u) AS u FROM hds
    LEFT JOIN (SELECT host, {upper} AS u FROM hp) h ON h.host = hds.host LEFT JOIN (SELECT domain, {upper} AS u FROM dp) d ON d.domain = hds.domain
    LEFT JOIN (SELECT suffix, {upper} AS u FROM sp) s ON s.suffix = hds.suffix, (SELECT {upper} AS u FROM cp) c
), rules AS (
{fits}
), fit AS (
    SELECT p0.page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
    FROM p0 JOIN rules ON (p0.host = h OR p0.host LIKE '%.' || h) AND starts_with(p0.path, p) GROUP BY 1
)
SELECT p0.page_id, p0.host, p0.path, fit.rule, coalesce(fit.verdict, CASE WHEN v.u < {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p0 JOIN verdicts v USING (host) LEFT JOIN fit USING (page_id)"""


QUERIES = {"op9_url_filter": lambda spark, sf_dir: op9_url_filter(spark, sf_dir).drop("upper")}
ORACLE_SQL = {"op9_url_filter": _sql()}
