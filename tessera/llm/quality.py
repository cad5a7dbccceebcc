"""Quality scores by Bradley-Terry pairwise ranking.

Each preference pair is a good and a bad labelled document; the probability that the good one wins is the logistic
function of the difference of their scores, and a score is linear in the document's dense features. The weights
minimise the logistic loss on feature differences (Newton's method, ridge penalty). Documents are then kept above a
quantile of the training scores: the level at which the two labels are told apart best.

Learnt from a bounded sample: at most ``sample`` labelled rows in the order of a hash of the id, and ``pairs`` pairs.
All documents are scored, whole, in one pass without a shuffle.

Defined results: null and empty texts have the features of an empty text; without both labels every score is 0.5;
null labels and null ids aren't learnt from; repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, picked
from .text_features import QUALITY, quality_features

SAMPLE, PAIRS, RIDGE, SEED = 20_000, 100_000, 1e-3, 11
CUT = 0.3


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: float
    slope: float
    #: The quantile of the training scores at which documents are cut.
    quantile: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.at) + np.log(CUT / (1 - CUT)), -40, 40)))


def sampled(docs: DataFrame, labels: DataFrame, label: str, mod: int, left_out: int, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most `sample` labelled rows outside the fold that is held out."""
    rows = picked(labels, {"doc_id": doc_id, "label": label}).where("label is not null and doc_id is not null").where(fold("doc_id", mod) != left_out)
    rows = rows.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return picked(docs, {"doc_id": doc_id, "text": text}).join(F.broadcast(rows), "doc_id")


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = SEED) -> Ranker:
    """Fit on a feature matrix and 0/1 labels."""
    k = x.shape[1] if len(x) else len(QUALITY)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.0 if CUT == 0.5 else 1.0, 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(k)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.sort(raw)
    levels = np.unique(np.linspace(0, len(order) - 1, 2001).astype(int))
    # of all levels, the one with the least mean of the two error rates; between two scores, in the middle
    error = [(raw[good] < order[i]).mean() + (raw[bad] >= order[i]).mean() for i in levels]
    best = int(levels[int(np.argmin(error))])
    at = (order[best] + order[max(best - 1, 0)]) / 2
    return Ranker(mean, scale, w, float(at), float(4 / max(raw.std(), 1e-9)), best / len(order))


def train(rows: DataFrame, **more) -> Ranker:
    """Fit on (doc_id, text, label) rows; only their feature vectors reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in quality_features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("text", "doc_id", "label").mapInArrow(work, f"doc_id {kind}, label int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(got.num_rows, len(QUALITY))
    return fit(x, got["label"].to_numpy(), **more)


def score(docs: DataFrame, ranker: Ranker, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score: one row per row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in quality_features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], pa.array(ranker.scores(x))], ["doc_id", "score"])

    rows = picked(docs, {"_text": text, "doc_id": doc_id})
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
