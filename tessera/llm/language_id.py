"""Language identification by rank-order profiles of character n-grams.

Each language's profile is its most frequent n-grams (1 to 3 characters) in rank order, counted over all training
texts. A document's own most frequent n-grams are ranked likewise; its distance to a language is the sum of the
differences in rank, an n-gram that the profile lacks counting as the profile's length. The nearest language wins,
ties by name. score is the winner's share of agreement: 1 - distance / largest possible distance.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if there is nothing to learn from.
Training rows with a null language or text are left out. Ties in counts are ordered by the n-gram. Repeated rows
are each predicted; whole texts of any length are counted, in slices of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold, picked, unused

#: N-grams in a profile, and of a document that are ranked.
PROFILE = 400
SLICE = 1 << 20
UND = "und"


@cache
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the lower-cased letters, runs of all else taken as one space, and their counts."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts = []
    last = np.array([32], dtype=np.uint64)  # up to two codes that stand before the slice
    for at in range(0, len(text), SLICE):
        code = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        code = np.where(letters()[code], code, np.uint64(32))
        if at + SLICE >= len(text):
            code = np.append(code, np.uint64(32))
        code = code[(code != 32) | (np.concatenate([last[-1:], code[:-1]]) != 32)]
        line = np.concatenate([last, code])
        two = (line[:-1] << np.uint64(21)) | line[1:]
        three = (two[:-1] << np.uint64(21)) | line[2:]
        parts.append(np.unique(np.concatenate([code[code != 32], two[len(last) - 1 :], three]), return_counts=True))
        last = line[-2:]
    if len(parts) == 1:
        return parts[0]
    grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def top(grams: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, in order of count and then of the n-gram."""
    if len(grams) > 4 * n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:n]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """Each language's n-grams in rank order, from all rows of docs.

    Tasks sum their own counts and hand them over when their number passes a bound; what reaches the driver is
    `profile` numbers a language.
    """
    rows = picked(docs, {"lang": lang, "text": text}).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def merged(parts):
            grams, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out():
            for name, parts in held.items():
                g, c = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                g, c = gram_counts(value.as_py())
                held.setdefault(name, []).append((g, c))
                size += len(g)
                if size > 1_000_000:
                    held = {k: [merged(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 500_000:
                        yield from out()
                        held, size = {}, 0
        yield from out()

    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in best.collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["gram"]))
    return {k: [g for _, g in sorted(v)] for k, v in sorted(found.items())}


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], doc_id: str = "doc_id", text: str = "text", profile: int = PROFILE, more: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """One row per row of docs, without a shuffle: doc_id, or else the columns named in more, and the prediction and its score under these names."""
    out_names = names
    names = list(profiles)
    known = np.unique(np.concatenate([np.array(p, dtype=np.uint64) for p in profiles.values()])) if names else np.zeros(0, np.uint64)
    ranks = np.full((len(names), len(known) + 1), profile, dtype=np.int32)
    for k, name in enumerate(names):
        ranks[k, np.searchsorted(known, np.array(profiles[name], dtype=np.uint64))] = np.arange(len(profiles[name]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(0):
                value = value.as_py()
                grams, counts = gram_counts(value or "")
                if not names or not len(grams) or (len(grams) == 1 and grams[0] == 32) or not (grams < (1 << 21)).any():
                    langs.append(UND)
                    scores.append(0.0)
                    continue
                own = top(grams, counts.astype(np.int64), profile)
                at = np.searchsorted(known, own)
                at[known[np.minimum(at, len(known) - 1)] != own] = len(known)
                r = ranks[:, at]
                apart = np.where(r == profile, profile, np.abs(r - np.arange(len(own)))).sum(axis=1)
                k = int(apart.argmin())
                langs.append(names[k])
                scores.append(1.0 - float(apart[k]) / (profile * len(own)))
            kept = [batch.column(0), *batch.columns[1:]] if whole else batch.columns[1:]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*given, *out_names])

    # the text goes to the workers once
    keep = {c: c for c in more} if more else {"doc_id": doc_id}
    whole = text in keep
    given = [text, *(c for c in keep if c != text)] if whole else list(keep)
    first = text if whole else unused([*keep, *out_names], "text")[0]
    rows = picked(docs, {first: text} | {c: keep[c] for c in given if c != first})
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in given), StructField(out_names[0], StringType()), StructField(out_names[1], DoubleType())])
    return rows.mapInArrow(work, schema)


def trained_on(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows to learn from: crc32 of the id, modulo 3, is not 1."""
    return docs.where(fold(doc_id, 3) != 1)
