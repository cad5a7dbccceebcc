"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped for scoring.

Tokens are words (64-bit hashes) and one end token. Tasks sum the bigrams of their texts before a shuffle by bigram;
contexts and words are summed from the distinct bigrams in turn, with partial sums before each shuffle, so a word that
follows or precedes every other meets no single task. The model is two sets of sorted hash arrays in the shared
folder, dealt into shards by the hash's top bits, which the scoring tasks memory-map: words (count, continuation
probability, and as a context total count and back-off weight) and bigrams (count). Pages are read as needed and shared
by a machine's workers; no task loads a whole model.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v.) + (D1 N1(v.) + D2 N2(v.) + D3 N3+(v.)) / c(v.) p(w)
    p(w)     = max(n(.w) - E(n(.w)), 0) / n(..) + (E1 M1 + E2 M2 + E3 M3+) / n(..) / (V + 1)

c counts bigrams, n(.w) counts the distinct words before w, Ni and Mi the followers and words with count i (3+: three or
more), V the distinct training tokens; one further word stands for all unknown ones, so the probabilities sum to one.
A text's first word is judged after the end token of the one before. Discounts are those of Chen and Goodman from the
counts of counts, and held within [0, i].

Defined results: null and empty texts are the end token alone; without training texts every token has probability
1 / (V + 1) = 1; repeated rows are each counted and scored. The order is two because a trigram's tables would need
more disk than the input several times over (see the README).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, local_path, picked, saved, scratch
from .textbytes import LOWER, chunks, mix, slice_hashes, words

#: The end token, which no word's hash is made of; flush size of a task's own sums.
END = np.uint64(0x5851F42D4C957F2D)
HELD = 400_000
WORD = np.dtype([("key", "<u8"), ("count", "<i8"), ("prob", "<f8"), ("total", "<f8"), ("backoff", "<f8")])
PAIR = np.dtype([("key", "<u8"), ("count", "<i8")])
#: Files of a model that a worker keeps open.
OPEN = 4096


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with each text's end token, offsets) by chunks."""
    for a, b, data, offsets in chunks(column):
        low = LOWER[data]
        start, end, row = words(low, offsets)
        h = slice_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
        n = np.bincount(row, minlength=b - a)[: b - a] + 1
        ends = np.cumsum(n)
        out = np.full(ends[-1], END)
        keep = np.ones(ends[-1], bool)
        keep[ends - 1] = False
        out[keep] = h
        yield a, b, out, np.concatenate([[0], ends])


def before(token: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The token before each: at a text's start, the end token."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[offsets[:-1]] = END
    return out


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0x9E3779B97F4A7C15) ^ (w + (v >> np.uint64(7))))


def bigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """v, w, n: the count of each bigram of all texts, written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(v, w, n):
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(w.view(np.int64)), pa.array(n)], ["v", "w", "n"])

        vs, ws = [], []
        for batch in batches:
            for _, _, token, offsets in tokens(batch.column(0)):
                vs.append(before(token, offsets))
                ws.append(token)
                if sum(map(len, ws)) > HELD:
                    yield out(*summed(np.concatenate(vs), np.concatenate(ws)))
                    vs, ws = [], []
        if ws:
            yield out(*summed(np.concatenate(vs), np.concatenate(ws)))

    rows = picked(docs, {"text": text}).mapInArrow(work, "v long, w long, n long")
    return saved(rows.groupBy("v", "w").agg(F.sum("n").alias("n")), "bigrams")


def summed(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their counts."""
    key = pair_key(v, w)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return v[first], w[first], n


@lru_cache(OPEN)
def _mapped(path: str, kind: np.dtype) -> np.ndarray | None:
    """A file of a finished model; None where a shard has no key."""
    return np.memmap(path, dtype=kind, mode="r") if os.path.exists(path) else None


@dataclass
class Shards:
    """Sorted arrays in files of one folder, by the key's top bits."""

    folder: str
    bits: int
    kind: np.dtype

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The record of each key; zeros where there is none."""
        out = np.zeros(len(keys), self.kind)
        if not len(keys):
            return out
        kinds, inverse = np.unique(keys, return_inverse=True)
        found = np.zeros(len(kinds), self.kind)
        shard = (kinds >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(kinds), np.int64)
        bounds = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            table = _mapped(os.path.join(self.folder, f"{int(shard[a]):06d}"), self.kind)
            if table is None:
                continue
            at = np.minimum(np.searchsorted(table["key"], kinds[a:b]), len(table) - 1)
            got = table[at]
            hit = got["key"] == kinds[a:b]
            found[a:b][hit] = got[hit]
        return found[inverse]


def shards(df: DataFrame, kind: np.dtype, rows: int, name: str, rows_each: int = 1 << 19) -> Shards:
    """Write df (its columns in the order of kind, the key first) as sorted arrays. Tasks write whole files and rename them, so one that is run again changes nothing."""
    bits = max(0, int(rows // rows_each).bit_length())
    folder = local_path(scratch(df.sparkSession, name))
    os.makedirs(folder, exist_ok=True)
    names = df.columns
    shard = F.shiftrightunsigned(F.col(names[0]), 64 - bits).cast("int") if bits else F.lit(0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def write():
            os.makedirs(folder, exist_ok=True)
            table = np.concatenate(parts)
            table = table[np.argsort(table["key"], kind="stable")]
            own = os.path.join(folder, f".{at}-{uuid.uuid4().hex}")
            table.tofile(own)
            os.replace(own, os.path.join(folder, f"{at:06d}"))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(table)], pa.int64())], ["shard", "n"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            table = np.zeros(batch.num_rows, kind)
            for field, c in zip(kind.names, cols):
                table[field] = c.view(np.uint64) if field == "key" else c
            bounds = np.flatnonzero(np.concatenate([[True], cols[-1][1:] != cols[-1][:-1], [True]])) if len(table) else []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if parts and cols[-1][a] != at:
                    yield write()
                    parts = []
                at = int(cols[-1][a])
                parts.append(table[a:b])
        if parts:
            yield write()

    dealt = df.withColumn("shard", shard).repartition(max(1, min(1 << bits, 4096)), "shard").sortWithinPartitions("shard")
    dealt.mapInArrow(work, "shard int, n long").agg(F.sum("n")).collect()
    return Shards(folder, bits, kind)


@dataclass
class Model:
    words: Shards
    pairs: Shards
    discounts: np.ndarray
    #: Tokens, distinct tokens, and the probability of a word that was never seen.
    n: int
    v: int
    unknown: float

    def scores(self, token: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: known tokens, base score, model score (log10)."""
        prior = before(token, offsets)
        kinds, inverse = np.unique(np.concatenate([token, np.array([END])]), return_inverse=True)
        word = self.words.lookup(kinds)
        inverse = inverse[:-1]
        context_at = np.concatenate([inverse[:1], inverse[:-1]])
        context_at[offsets[:-1]] = np.searchsorted(kinds, END)
        own, context = word[inverse], word[context_at]
        count = own["count"]
        low = np.where(count > 0, own["prob"], self.unknown)
        c = self.pairs.lookup(pair_key(prior, token))["count"].astype(np.int64)
        total = context["total"]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(total > 0, np.maximum(c - self.discounts[np.minimum(c, 3)], 0) / total + context["backoff"] * low, low)
            base = np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))
            each = np.log10(p)
        add = lambda x: np.add.reduceat(x, offsets[:-1])  # noqa: E731  each text has its end token at least
        return add((count > 0).astype(np.int64)), add(base), add(each)


def discounts(counts: list[int]) -> np.ndarray:
    """D(0..3+) from the number of kinds that occur once, twice, three and four times."""
    n1, n2, n3, n4 = (max(x, 0) for x in counts)
    if not n1:
        return np.zeros(4)
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *(min(max(d[i], 0.05), i) for i in (1, 2, 3))])


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count all texts of docs and write the model."""
    pairs = bigrams(docs, text)
    kinds = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    top = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds"), *kinds).collect()[0]
    d = discounts([top[f"n{i}"] or 0 for i in (1, 2, 3, 4)])
    right = pairs.groupBy(F.col("w").alias("key")).agg(F.sum("n").alias("count"), F.count("*").alias("left"))
    cut = sum(F.when(F.col("n") == i if i < 3 else F.col("n") >= 3, d[i]).otherwise(0.0) for i in (1, 2, 3))
    context = pairs.groupBy(F.col("v").alias("key")).agg(F.sum("n").cast("double").alias("total"), F.sum(cut).alias("cut"))
    right = saved(right.join(context, "key", "left"), "words", release=True)
    kinds = [F.sum((F.col("left") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    low = right.agg(F.count("*").alias("v"), F.coalesce(F.sum("left"), F.lit(0)).alias("total"), F.sum((F.col("left") >= 3).cast("long")).alias("n3p"), *kinds).collect()[0]
    e = discounts([low[f"n{i}"] or 0 for i in (1, 2, 3, 4)])
    v, total = low["v"], max(low["total"], 1)
    freed = e[1] * (low["n1"] or 0) + e[2] * (low["n2"] or 0) + e[3] * (low["n3p"] or 0)
    unknown = freed / total / (v + 1) if v else 1.0
    less = F.when(F.col("left") == 1, float(e[1])).when(F.col("left") == 2, float(e[2])).otherwise(float(e[3]))
    prob = F.greatest(F.col("left") - less, F.lit(0.0)) / float(total) + float(unknown)
    table = right.select("key", "count", prob.alias("prob"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce(F.col("cut") / F.col("total"), F.lit(0.0)).alias("backoff"))
    keyed = pairs.mapInArrow(_keyed, "key long, count long")
    model = Model(shards(table, WORD, v, "kn-words"), shards(keyed, PAIR, top["kinds"], "kn-pairs"), d, int(top["tokens"]), int(v), float(unknown))
    dropped(right)
    dropped(pairs)
    return model


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v, w = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(pair_key(v, w).view(np.int64)), b.column(2)], ["key", "count"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs, without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, token, offsets in tokens(batch.column(0)):
                known, base, own = model.scores(token, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[a:b], pa.array(np.diff(offsets)), pa.array(known), pa.array(np.full(b - a, model.n)), pa.array(base), pa.array(own)],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rows = picked(docs, {"_text": text, "doc_id": doc_id})
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
