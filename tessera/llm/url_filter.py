"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's rate of good
pages is a beta-binomial posterior whose prior is the level above: corpus -> suffix -> registered domain
-> host, each prior worth a fitted number of pages. A host is blocked when the upper bound of its posterior
rate of good pages is below a threshold.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the
verdict of the corpus rate; hosts without outcomes fall back on their domain, suffix and corpus. Repeated rows
are judged each. An empty pages table gives an empty result; without outcomes the prior is even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, picked, saved, small

#: Second-level names that registries sell under, so that the registered domain has three labels.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Bounds of the prior's weight in pages, and the posterior's width in standard deviations.
LEAST_WEIGHT, MOST_WEIGHT, WIDTH, THRESHOLD = 2.0, 1000.0, 1.6448536269514722, 0.5
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: two labels, or three under names such as co.uk."""
    name, labels = F.regexp_replace(host, r"^.*@|:\d*$", ""), F.split(F.regexp_replace(host, r"^.*@|:\d*$", ""), r"\.")
    under = (F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(under, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(domain: Column) -> Column:
    """What follows the registered domain's first label."""
    return F.regexp_replace(domain, r"^[^.]*\.", "")


def _weight(rows: DataFrame) -> DataFrame:
    """Method of moments for the beta-binomial: the weight in pages of the level above. One row."""
    p = F.col("good") / F.col("n")
    mean = F.sum("good") / F.sum("n")
    stats = rows.where("n > 0").agg(F.count("*").alias("k"), mean.alias("m"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.sum(F.col("n") * p * p).alias("pp"))
    spread = F.col("pp") - F.col("s") * F.col("m") * F.col("m")
    between = (spread - (F.col("k") - 1) * F.col("m") * (1 - F.col("m"))) / (F.col("s") - F.col("ss") / F.col("s"))
    weight = F.when((F.col("k") > 1) & (F.col("s") > F.col("ss") / F.col("s")) & (between > 0), F.col("m") * (1 - F.col("m")) / between - 1)
    return stats.select(F.least(F.greatest(F.coalesce(weight, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("w"))


def reputation(outcomes: DataFrame, host: str = "host", good: str = "good", threshold: float = THRESHOLD) -> dict[str, DataFrame]:
    """Posteriors by level from one row per labelled page (host, good 0/1).

    Returns host, domain and suffix tables (name, a, b, upper, verdict) and a one-row corpus table. Rows with a
    null outcome are no outcomes.
    """
    o = picked(outcomes, {"host": host, "good": good}).where("good is not null and host is not null")
    hosts = saved(
        o.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("double")).alias("good")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    corpus = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(((F.col("good") + 1) / (F.col("n") + 2)).alias("mean"), F.lit(LEAST_WEIGHT).alias("w0"))

    def bound(df: DataFrame) -> DataFrame:
        a, b = F.col("a"), F.col("b")
        mean = a / (a + b)
        df = df.withColumn("upper", mean + WIDTH * F.sqrt(mean * (1 - mean) / (a + b + 1)))
        return df.withColumn("verdict", F.when(F.col("upper") < threshold, "block").otherwise("allow"))

    def posterior(rows: DataFrame, above: DataFrame | None, key: str | None) -> DataFrame:
        prior = rows.crossJoin(F.broadcast(corpus.select("mean"))) if above is None else rows.join(above.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), key)
        prior = prior.crossJoin(F.broadcast(_weight(rows)))
        return bound(prior.withColumn("a", F.col("w") * F.col("mean") + F.col("good")).withColumn("b", F.col("w") * (1 - F.col("mean")) + F.col("n") - F.col("good")).drop("mean", "w"))

    s = posterior(suffixes, None, None)
    d = posterior(domains, s, "suffix")
    h = posterior(hosts, d.drop("suffix"), "domain")
    top = bound(corpus.select((F.col("mean") * F.col("w0")).alias("a"), ((1 - F.col("mean")) * F.col("w0")).alias("b")))
    return {"host": h, "domain": d, "suffix": s, "corpus": top}


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, upper (the bound behind the method's verdict).

    outcomes: (host, good). rules: (verdict, host, path). A rule fits its host and all subdomains when the path
    starts with the rule's; the longest wins. The distinct hosts are judged once; their table is broadcast only
    after a count, and pages are never shuffled otherwise than by that join.
    """
    p = picked(pages, {"page_id": id_col, "url": url_col}).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rep = reputation(outcomes, threshold=threshold)
    hosts = p.groupBy("host").agg(F.lit(1).alias("one")).drop("one")
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    for level in ("host", "domain", "suffix"):
        hosts = hosts.join(rep[level].select(level, F.col("upper").alias(f"u_{level}")), level, "left")
    hosts = hosts.crossJoin(F.broadcast(rep["corpus"].select(F.col("upper").alias("u_corpus"))))
    hosts = hosts.select("host", F.coalesce("u_host", "u_domain", "u_suffix", "u_corpus").alias("upper"))
    hosts = small(saved(hosts, "verdicts"))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for what, h, q in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(q)
        rule, verdict = F.when(fits, h + q).otherwise(rule), F.when(fits, what).otherwise(verdict)
    by_method = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return p.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "upper")
