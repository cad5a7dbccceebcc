"""Host reputation against a plain version, and the table's odd cases."""

import math

import pytest

from tessera.llm.op9 import RULES
from tessera.llm.url_filter import LEAST_WEIGHT, MOST_WEIGHT, THRESHOLD, WIDTH, judge

PAGE, OUT = "page_id long, url string, verdict string, host string", "host string, good int, domain string"


def weight(rows):
    """Method of moments over (good, n)."""
    k, s = len(rows), sum(n for _, n in rows)
    m, ss = sum(g for g, _ in rows) / s, sum(n * n for _, n in rows)
    if k < 2 or s <= ss / s:
        return MOST_WEIGHT
    between = (sum(n * (g / n - m) ** 2 for g, n in rows) - (k - 1) * m * (1 - m)) / (s - ss / s)
    w = m * (1 - m) / between - 1 if between > 0 else MOST_WEIGHT
    return min(max(w, LEAST_WEIGHT), MOST_WEIGHT)


def brute(outcomes):
    """upper bound by host, of hosts of the form x.y.z: domain y.z, suffix z."""
    def summed(key):
        out = {}
        for h, g in outcomes:
            a, n = out.get(key(h), (0, 0))
            out[key(h)] = (a + g, n + 1)
        return out

    hosts, domains, suffixes = summed(lambda h: h), summed(lambda h: h.split(".", 1)[1]), summed(lambda h: h.rsplit(".", 1)[1])
    mean = (sum(g for _, g in outcomes) + 1) / (len(outcomes) + 2)
    bound = lambda a, b: a / (a + b) + WIDTH * math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
    w = [weight(list(t.values())) for t in (suffixes, domains, hosts)]
    post = lambda w, prior, g, n: (w * prior + g, w * (1 - prior) + n - g)
    s = {k: post(w[0], mean, *v) for k, v in suffixes.items()}
    d = {k: post(w[1], s[k.split(".")[1]][0] / sum(s[k.split(".")[1]]), *v) for k, v in domains.items()}
    h = {k: post(w[2], d[k.split(".", 1)[1]][0] / sum(d[k.split(".", 1)[1]]), *v) for k, v in hosts.items()}
    return {k: bound(*v) for t in (s, d, h) for k, v in t.items()}, bound(mean * LEAST_WEIGHT, (1 - mean) * LEAST_WEIGHT)


def test_matches_a_plain_version(spark):
    import random

    rng = random.Random(0)
    outcomes = [(f"h{rng.randrange(3)}.d{d}.{'xy'[d % 2]}", int(rng.random() < (0.1, 0.9, 0.5, 0.2)[d])) for d in range(4) for _ in range(40)]
    want, corpus = brute(outcomes)
    urls = sorted({f"http://{h}/p" for h, _ in outcomes}) + ["http://new.d0.x/", "http://new.new.y", "http://new.new.new/a?b#c"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], PAGE)
    for r in judge(pages, spark.createDataFrame([(h, g, "z") for h, g in outcomes], OUT), []).collect():
        host = r["host"]
        upper = next((want[k] for k in (host, host.split(".", 1)[1], host.rsplit(".", 1)[1]) if k in want), corpus)
        assert r["upper"] == pytest.approx(upper) and r["verdict"] == ("block" if upper < THRESHOLD else "allow") and r["rule"] is None


def test_rules_and_odd_urls(spark):
    rows = {
        "HTTPS://WWW.Example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"), "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
        "http://example.com/en": ("example.com", "/en", "com/", "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "x://b.net/fr/?q": ("b.net", "/fr/", "net/fr/", "block"),
        "http://com?x": ("com", "", None, None), "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "://": ("", "", None, None), "a://b://c/d": ("b:", "//c/d", None, None), "http://u@h.net:80/es/#f": ("u@h.net:80", "/es/", None, None),
    }
    pages = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(rows)] + [(0, next(iter(rows)), "", ""), (None, None, "", "")], PAGE)
    none = spark.createDataFrame([], OUT)
    out = judge(pages, none, RULES).collect()
    assert len(out) == len(rows) + 2 and sum(r["page_id"] == 0 for r in out) == 2
    for r in out:
        host, path, rule, verdict = list(rows.values())[r["page_id"]] if r["page_id"] is not None else ("", "", None, None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or "allow")
    assert judge(pages.limit(0), none, RULES).count() == 0
    odd = spark.createDataFrame([(None, 1, ""), ("b.net", None, ""), ("b.net", 0, "")], OUT)
    assert judge(pages, odd, RULES).count() == len(rows) + 2
