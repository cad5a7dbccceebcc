"""Language ID against brute force; held-out accuracy of the classifiers on the test tables."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id as li
from tessera.llm import op3, op5, op10, toxicity
from tessera.llm.quality import fit
from tessera.llm.text_features import quality_features, toxicity_features

SF = "/root/testdata/sf0.01"


def grams(text):
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    s = re.sub(" +", " ", s)
    out = Counter(c for c in s if c != " ")
    for n in (2, 3):
        out.update(s[i : i + n] for i in range(len(s) - n + 1))
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return Counter({code(g): n for g, n in out.items()})


def test_grams_of_sliced_texts(monkeypatch):
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(li, "SLICE", size)
        for text in ("Hello, wörld  foo", "  a ", "a", "x1y2  z", "日本 語"):
            g, n = li.gram_counts(text)
            assert dict(zip(g.tolist(), n.tolist())) == dict(grams(text))


def test_language_id_matches_brute_force(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("the end", None), (None, "en"), ("12 !!", "en"), ("", "de"), ("und der", "de"), ("the " * 500, "en")])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    profiles = li.learn(df, profile=20)
    want = {}
    for lang in ("de", "en", "fr"):
        total = sum((grams(t) for _, t, l in rows if l == lang and t is not None), Counter())
        want[lang] = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))][:20]
    assert profiles == want
    for r in li.predict(df, profiles, profile=20).collect():
        text = rows[r["doc_id"]][1]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = [g for g, _ in sorted(grams(text).items(), key=lambda x: (-x[1], x[0]))][:20]
        apart = {l: sum(abs(i - p.index(g)) if g in p else 20 for i, g in enumerate(own)) for l, p in want.items()}
        best = min(sorted(apart), key=apart.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - apart[best] / (20 * len(own)))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string").selectExpr("*", "string(null) as lang")
    assert [r["lang_pred"] for r in li.predict(df, li.learn(df)).collect()] == ["und"]


def held_out(spark, df, truth, table):
    rows = df.join(spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id", truth), "doc_id").where("held_out").collect()
    return rows


def test_language_accuracy(spark):
    rows = held_out(spark, op10.op10_language_id(spark, SF), "lang", "documents")
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_quality_accuracy(spark):
    out = op3.op3_quality(spark, SF)
    rows = held_out(spark, out, "quality", "labels")
    assert sum(r["quality"] == r["predicted"] for r in rows) >= 0.95 * len(rows)
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_accuracy(spark):
    rows = held_out(spark, op5.op5_toxicity(spark, SF), "toxic", "labels")
    assert sum(r["toxic"] == r["predicted"] for r in rows) >= 0.9 * len(rows)


def test_features_of_edge_texts():
    texts = pa.array([None, "", " ", "\n\n", "a", "ÀÉ ü", "x" * 50_000, "you idiot, you l0ser!"])
    q = np.concatenate([x for _, _, x in quality_features(texts)])
    t = np.concatenate([x for _, _, x in toxicity_features(texts, {"idiot": 2.0, "loser": 3.0}, {"idio": 1.0})])
    assert len(q) == len(t) == 8 and np.isfinite(q).all() and np.isfinite(t).all()
    assert t[7, 0] > 0 and t[7, 15] > 0 and (q[0] == q[1]).all()


def test_one_label_only():
    assert (fit(np.zeros((0, 22)), np.zeros(0)).scores(np.zeros((2, 22))) <= 1).all()
    x = np.array([[0.0], [1], [2], [3], [4], [5]] * 20)
    trees = toxicity.grow(x, (x[:, 0] > 2).astype(float), trees=20)
    raw = trees.raw(x)
    assert raw[x[:, 0] > 2].min() > raw[x[:, 0] <= 2].max()
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 3]), np.array([0, 1, 0, 1.0]))
    assert (np.diff(values) >= 0).all() and values[0] == 0
