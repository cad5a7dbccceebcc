"""Features and scores of the classifiers against plain versions, and the operators' odd cases."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality, toxicity
from tessera.llm import text_features as tf

TEXTS = [None, "", " \n\t ", "a", "The cat, the cat!\nTHE CAT | sat -- sat\n\nThe cat, the cat!", "ÀÉ ünï 12 $$ & x@y.z #tag", "you l0s3r, you IDIOT!! i-d-i-o-t du", "x" * 3000 + " " + "y z " * 50, "|\n|\n|", "word\x0bword\x0cword\rword"]
SPACES = "\x20\t\n\x0b\x0c\r"


def plain_quality(text):
    text = text or ""
    raw = text.encode()
    size = max(len(raw), 1)
    w = [x for x in re.split(f"[{SPACES}]+", text) if x]
    many = max(len(w), 1)
    lines = [x for x in text.split("\n") if x]
    share = lambda chars: sum(chr(b) in chars for b in raw if b < 128) / size
    link, symbol, loud = "|/\\<>=_~^[]{}", "#$%&*@+", "!?"
    repeats = sum(a == b for a, b in zip(w, w[1:]))
    length = [len(x.encode()) for x in w]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [
        math.log1p(len(w)), sum(length) / many, share(upper), share("0123456789"), sum(b > 127 for b in raw) / size, share(".,;:'\"()-"), share(loud), share(link), share(symbol), share(SPACES),
        len(set(w)) / many, repeats / many, (len(lines) - len(set(lines))) / max(len(lines), 1), math.log1p(len(w) / max(len(lines), 1)),
        sum(n <= 2 for n in length) / many, sum(n >= 12 for n in length) / many, sum(x[-1] in symbol for x in w) / many, sum(len(x) > 1 and x[0] in upper and x[1] in upper for x in w) / many,
        sum(n == 1 and x in link + symbol for n, x in zip(length, w)) / many, sum(x[-1] in loud for x in w) / many, math.sqrt(share(symbol)), math.sqrt(repeats / many),
    ]


def test_quality_features_match_a_plain_version():
    got = np.concatenate([x for _, _, x in tf.quality_features(pa.array(TEXTS))])
    for text, row in zip(TEXTS, got):
        assert row == pytest.approx(plain_quality(text)), text


def test_toxicity_features_match_a_plain_version():
    lexicon, stems = {"idiot": 2.0, "loser": 3.0, "sat": 1.0}, {"idio": 1.5, "lose": 0.5}
    got = np.concatenate([x for _, _, x in tf.toxicity_features(pa.array(TEXTS), lexicon, stems)])
    for text, row in zip(TEXTS, got):
        words = [x for x in re.split(f"[{SPACES}]+", text or "") if x]
        many, facts = max(len(words), 1), []
        for x in words:
            word = tf.plain(x.lower())
            masked = len(word) > 2 and re.search(r"[0-9@$!|*.\-_]", word) is not None
            facts.append((lexicon.get(word, 0), max(stems.get(word[:k], 0) for k in tf.STEMS), word in tf.SECOND_PERSON, lexicon.get(tf.unmasked(word), 0) if masked and word not in lexicon else 0))
        hits, un, you = sum(f[0] > 0 for f in facts), sum(f[3] > 0 for f in facts), sum(f[2] for f in facts)
        near = sum(any(facts[j][2] for j in range(max(0, i - tf.NEAR), min(len(facts), i + tf.NEAR + 1)) if j != i) and (f[0] > 0 or f[3] > 0) for i, f in enumerate(facts))
        want = {"hits": hits / many, "any_hit": float(hits > 0), "log_hits": math.log1p(hits), "strongest": max([max(f[0], f[3]) for f in facts], default=0), "stem_rate": sum(f[1] > 0 for f in facts) / many, "best_stem": max([f[1] for f in facts], default=0), "you": you / many, "unmasked": un / many, "near_you": near / max(hits, 1), "log_words": math.log1p(len(words))}
        assert {k: row[tf.TOXIC.index(k)] for k in want} == pytest.approx(want), text


def test_weights_are_the_least_loss_and_scores_its_logistic():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = (x @ [1.0, -1, 0.5, 0] + 0.3 * rng.standard_normal(300) > 0).astype(float)
    r = quality.fit(x, y, pairs=2000)
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -8, 8)
    draw = np.random.default_rng(quality.SEED)
    d = z[draw.choice(np.flatnonzero(y == 1), 2000)] - z[draw.choice(np.flatnonzero(y == 0), 2000)]
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + quality.RIDGE * w @ w / 2
    assert all(loss(r.weights) <= loss(r.weights + e) for e in 1e-2 * rng.standard_normal((50, 4)))
    raw = [sum(a * b for a, b in zip(row, r.weights)) for row in z]
    want = [1 / (1 + math.exp(-(r.slope * (v - r.at) + math.log(quality.CUT / (1 - quality.CUT))))) for v in raw]
    assert r.scores(x) == pytest.approx(want)
    # the cut is a quantile of the training scores, at which the two labels' errors are least
    order = sorted(raw)
    error = lambda c: np.mean([v < c for v, l in zip(raw, y) if l]) + np.mean([v >= c for v, l in zip(raw, y) if not l])
    assert error(r.at) <= min(map(error, order)) + 1e-9 and sum(v < r.at for v in raw) / len(raw) == pytest.approx(r.quantile)


def test_trees_and_isotonic_calibration_match_plain_versions():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = toxicity.grow(x, y, trees=10)
    for row, got in zip(x, trees.raw(x)):
        total = trees.start
        for f, t, v in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert got == pytest.approx(total)
    raw, label = np.round(rng.standard_normal(60), 1), (rng.random(60) < 0.5).astype(float)
    knots, values = toxicity.isotonic(raw, label)
    # the fit at each point is the largest mean that begins at or before it of the least means that end at or after it
    kinds = np.unique(raw)
    for v in kinds:
        best = max(min(label[(raw >= a) & (raw <= b)].mean() for b in kinds[kinds >= v]) for a in kinds[kinds <= v])
        assert np.interp(v, knots, values) == pytest.approx(best)


@pytest.mark.parametrize("kind,ids", [("string", "abcdefgh"), ("long", range(8))])
@pytest.mark.parametrize("module", [quality, toxicity])
def test_ids_of_any_type_nulls_repeats_and_empty_tables(spark, module, kind, ids):
    texts = ["good words here and there", "bad $$$ ### you idiot", None, "", "x y z"]
    docs = spark.createDataFrame([(i, t, "zz", 9.0) for i, t in zip(ids, texts * 2)] + [(None, "a", "zz", 9.0), (list(ids)[0], texts[0], "zz", 9.0)], f"doc_id {kind}, text string, label string, score double")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] + [(None, 1), (list(ids)[1], None)], f"doc_id {kind}, good int")
    model = module.train(quality.sampled(docs, labels, "good", 5, 0))
    out = module.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    same = [r["score"] for r in out if r["doc_id"] == list(ids)[0]]
    assert len(same) == 2 and same[0] == same[1]
    none = module.train(quality.sampled(docs, labels.limit(0), "good", 5, 0))
    assert len({r["score"] for r in module.score(docs, none).collect()}) == 1
    assert module.score(docs.limit(0), model).count() == 0
