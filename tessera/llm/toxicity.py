"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of the whole text: densities of a learnt lexicon of words and of word beginnings, second-person words near
lexicon words, capitals, punctuation, and disguised words whose plain form is in the lexicon. Trees are grown on the
logistic loss over binned features; the raw scores are made probabilities by isotonic regression.

Learnt from a bounded sample of at most ``sample`` labelled rows in the order of a hash of the id; half of them give
the lexica, the others the trees, and the calibration uses scores of trees that haven't seen the row.
Lexica hold at most ``LEXICON`` entries. All documents are scored, whole, in one pass without a shuffle.

Defined results: null and empty texts have the features of an empty text; without both labels every score is the
rate of label 1 (0 without labels); null labels and ids aren't learnt from; repeated rows are each scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked
from .text_features import STEMS, TOXIC, toxicity_features

TREES, DEPTH, RATE, BINS, LEAST, LEXICON = 80, 3, 0.15, 32, 5, 3000
CUT = 0.7


@dataclass
class Trees:
    """Boosted regression trees of one depth, as arrays: for each tree and inner node a feature and a threshold, for each leaf a value."""

    start: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), int))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, least: int = LEAST) -> Trees:
    """Boost trees on the logistic loss by Newton gains over histograms."""
    n, k = x.shape
    p0 = min(max(y.mean(), 1e-6), 1 - 1e-6)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    inner, ridge = 2**DEPTH - 1, 1.0
    start = float(np.log(p0 / (1 - p0)))
    raw = np.full(n, start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        f, t = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, dtype=int)
        for depth in range(DEPTH):
            for a in range(2**depth - 1, 2 ** (depth + 1) - 1):
                mine = node == a
                best = (1e-9, 0, np.inf)
                if mine.sum() >= 2 * least:
                    gm, hm, bm = g[mine], h[mine], binned[mine]
                    gs, hs = gm.sum(), hm.sum()
                    for j in range(k):
                        m = len(edges[j]) + 1
                        if m < 2:
                            continue
                        gl, hl, cl = (np.cumsum(np.bincount(bm[:, j], weights=w, minlength=m))[:-1] for w in (gm, hm, np.ones(len(gm))))
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        gain[(cl < least) | (len(gm) - cl < least)] = -1
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, float(edges[j][i]))
                f[a], t[a] = best[1], best[2]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        at = node - inner
        value = rate * np.bincount(at, weights=g, minlength=2**DEPTH) / (np.bincount(at, weights=h, minlength=2**DEPTH) + ridge)
        raw = raw + value[at]
        features.append(f)
        thresholds.append(t)
        leaves.append(value)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the non-decreasing fit; equal scores are one point."""
    kinds, inverse = np.unique(raw, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, weights=y) / weight
    blocks: list[list[float]] = []  # value, weight, first, last
    for v, w, at in zip(value, weight, kinds):
        blocks.append([v, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _, z = blocks.pop()
            v1, w1, a, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, a, z])
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    values = np.array([b[0] for b in blocks for _ in range(2)])
    return knots, values


@dataclass
class Model:
    lexicon: dict[str, float]
    stems: dict[str, float]
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.zeros(len(x))
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.values), 0, 1)


def _lexicon(rows: DataFrame, stem: int | None = None, most: int = LEXICON) -> dict[str, float]:
    """Words (or their first `stem` letters) that mark label 1: log odds whose z-score is beyond chance. rows: text, label."""
    word = F.regexp_replace(F.col("w"), r"^[^\p{L}\p{N}_@$]+|[^\p{L}\p{N}_@$]+$", "")
    if stem:
        word = F.substring(word, 1, stem)
    each = rows.select("doc_id", "label", F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))).alias("w")).select("doc_id", "label", word.alias("w")).where(F.length("w") >= (stem or 1))
    each = each.groupBy("w", "doc_id", "label").agg(F.lit(1).alias("one"))
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    df = each.groupBy("w").agg(F.sum(F.col("label").cast("double")).alias("t"), F.sum((1 - F.col("label")).cast("double")).alias("c")).where("t >= 3")
    df = df.withColumn("weight", F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("c") + 0.5) / (good + 1)))
    df = df.withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    # so many words are tried that the largest z of chance alone grows with the root of twice the log of their number
    chance = math.sqrt(2 * math.log(max(df.count(), 2)))
    return {r["w"]: r["weight"] for r in df.where((F.col("z") > max(2.5, chance - 0.5)) & (F.col("weight") > 1.5)).orderBy(F.desc("z"), "w").limit(most).collect()}


def train(rows: DataFrame) -> Model:
    """Fit on (doc_id, text, label) rows; their features and the lexica reach the driver."""
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(6))
    rows = rows.withColumn("part", part)
    words = rows.where("part < 3")
    lexicon, stems = _lexicon(words), {k: v for n in STEMS for k, v in _lexicon(words, n).items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in toxicity_features(batch.column(0), lexicon, stems):
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), pa.array(list(x), pa.list_(pa.float64()))], [*batch.schema.names[1:], "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.where("part >= 3").select("text", "doc_id", "label", "part").mapInArrow(work, f"doc_id {kind}, label int, part long, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(got.num_rows, len(TOXIC))
    y, part = got["label"].to_numpy().astype(float), got["part"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(lexicon, stems, Trees(), np.zeros(min(len(y), 1)), np.full(min(len(y), 1), y.mean() if len(y) else 0.0))
    raw = np.zeros(len(y))
    for k in (3, 4, 5):  # each row's score by trees that haven't seen it
        if (part == k).any() and (part != k).any():
            raw[part == k] = grow(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lexicon, stems, grow(x, y), *isotonic(raw, y))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row per row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in toxicity_features(batch.column(0), model.lexicon, model.stems):
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(model.scores(x))], ["doc_id", "score"])

    rows = picked(docs, {"_text": text, "doc_id": doc_id})
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
