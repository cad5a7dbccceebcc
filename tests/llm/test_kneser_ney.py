"""The bigram model against a plain Python version."""

import math
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import kneser_ney as kn

DOC = "doc_id long, text string"


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) + [None]


def brute(train, texts):
    pairs, uni = Counter(), Counter()
    for t in train:
        ws = toks(t)
        uni.update(ws)
        pairs.update(zip([None, *ws[:-1]], ws))
    count = lambda c: [sum(1 for x in c if x == i) for i in (1, 2, 3, 4)]
    d = kn.discounts(count(pairs.values()))
    left, total, freed = Counter(w for _, w in pairs), Counter(), defaultdict(float)
    for (v, _), c in pairs.items():
        total[v] += c
        freed[v] += d[min(c, 3)]
    e = kn.discounts(count(left.values()))
    n, kinds, all_left = sum(uni.values()), len(uni), max(sum(left.values()), 1)
    unknown = sum(e[min(c, 3)] for c in left.values()) / all_left / (kinds + 1) if kinds else 1.0
    low = lambda w: max(left[w] - e[min(left[w], 3)], 0) / all_left + unknown if w in left else unknown
    out = []
    for t in texts:
        ws = toks(t)
        s = b = 0.0
        for v, w in zip([None, *ws[:-1]], ws):
            c = pairs[v, w]
            p = max(c - d[min(c, 3)], 0) / total[v] + freed[v] / total[v] * low(w) if total[v] else low(w)
            s += math.log10(p)
            b += math.log10((uni[w] + 0.5) / (n + 0.5 * (kinds + 1)))
        out.append((len(ws), sum(w in uni for w in ws), n, b, s))
    return out


TEXTS = ["a b a b c", "A  b\tc\nd", None, "", "   ", "x y z x y z x", "a b a b c", "é ü é b", "b " * 3000, "a\x0bb c a"]


@pytest.mark.parametrize("train", [TEXTS, TEXTS[:3], []])
def test_scores_match_brute_force(spark, train):
    model = kn.train(spark.createDataFrame(list(enumerate(train)), DOC))
    rows = sorted(kn.score(spark.createDataFrame(list(enumerate(TEXTS)), DOC), model).collect())
    for got, want in zip(rows, brute(train, TEXTS), strict=True):
        assert tuple(got)[1:4] == want[:3]
        assert got["base_score"] == pytest.approx(want[3], rel=1e-9)
        assert got["score"] == pytest.approx(want[4], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    import numpy as np

    model = kn.train(spark.createDataFrame(list(enumerate(TEXTS)), DOC))
    words = sorted({w for t in TEXTS for w in toks(t) if w})
    keys = {w: k for w, k in zip([*words, "unseen"], next(kn.tokens(__import__("pyarrow").array([" ".join([*words, "unseen"])])))[2])}
    for v in keys.values():
        total = 0.0
        for w in [*keys.values(), kn.END]:
            token = np.array([v, w, kn.END], np.uint64)
            both = model.scores(token, np.array([0, 3]))[2][0]
            ends = model.scores(np.array([w, kn.END], np.uint64), np.array([0, 2]))[2][0] - model.scores(np.array([w], np.uint64), np.array([0, 1]))[2][0]
            total += 10 ** (both - model.scores(np.array([v], np.uint64), np.array([0, 1]))[2][0] - ends)
        assert abs(total - 1) < 1e-9
