"""Decontamination against a plain search, with short items, overlaps and repeats."""

import hashlib
import random
import re

from tessera.llm.decontaminate import decontaminate

DOC = "doc_id long, text string, item_id long, n_words int"
ITEM = "item_id long, text string, f string"


def toks(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for k, t in docs:
        w, hit, found = toks(t), set(), set()
        for item, x in items:
            v = toks(x)
            n = min(10, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1) if v else ():
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        out.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_matches_plain_search(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "b", "c", "dé", "E1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 9, 10, 11, 14, 25, 25, 0])] + [(30, None), (31, "...")]
    docs = [(100, None), (101, ""), (102, "-- !!"), (103, "dé, dé; DÉ")]
    for i in range(40):
        w = [word() if rng.random() < 0.5 else "x%d" % rng.randrange(99) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = (rng.choice(items)[1] or "").split()[rng.randrange(3) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    got = decontaminate(spark.createDataFrame([(k, t, 0, 0) for k, t in docs], DOC), spark.createDataFrame([(k, t, "") for k, t in items], ITEM))
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, items)


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c", 0, 0), (1, "a b c", 0, 0), (1, "z", 0, 0), (None, "a b c", 0, 0)], DOC)
    none = spark.createDataFrame([], ITEM)
    assert [r["contaminated"] for r in decontaminate(docs, none).collect()] == [False] * 4
    one = spark.createDataFrame([(7, "b c", ""), (7, "B, c", "")], ITEM)
    assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate(docs, one).collect()) == [(1, 0, 0), (3, 2, 1), (3, 2, 1), (3, 2, 1)]
    assert decontaminate(spark.createDataFrame([], DOC), one).count() == 0


def test_item_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c", 0, 0)], DOC)
    got = decontaminate(docs, spark.createDataFrame([(None, "b c", "")], ITEM)).collect()[0]
    assert (got["n_hit"], got["n_items"], got["contaminated"], got["items_sha256"]) == (2, 0, True, hashlib.sha256(b"").hexdigest())


def test_only_ascii_is_lowered(spark):
    """Every character, alone and after a letter: A-Z become a-z and nothing else changes."""
    from pyspark.sql import functions as F

    from tessera.llm.common import lower_ascii

    points = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    texts = ["A" + chr(c) + "B" for c in points]
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(4).select("t", lower_ascii(F.col("t")).alias("low")).where(F.col("low") != F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert got.limit(5).collect() == []
