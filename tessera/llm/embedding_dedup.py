"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

Rotations are learnt by iterative quantisation on a bounded sample; a vector's code is the signs of its rotated
coordinates, over several rotations. The code's disjoint substrings are the keys of as many tables: codes that have a
substring alike share a bucket, and those of a bucket whose Hamming distance over the whole code is within the radius are
candidates, each pair in the first table in which its codes meet. Only codes are sent to the tables; then the original
vectors of those that have candidates are sent to where they have them, and the candidates are compared by their cosine in
double precision.

Equal vectors are one class, told by 128 bits and numbered; a class is compared once and weighted by its copies. A bucket of
more than ``BLOCK`` classes is dealt out as pairs of blocks, each one task's work of bounded size, so that a bucket with
a third of all vectors is compared whole. Blocks hand on sums of links and a spanning forest, not pairs.

Links are exact where found; recall is measured in the tests against brute force. Pairs of codes that meet in no table or
are beyond the radius are not found: at the threshold's angle of 18 degrees a bit differs with probability 0.1 if the mean
is zero. Signs are taken of the vectors less their mean, which widens the angle where they have a common direction; so the
probability is taken from each vector of the sample, and there are as many tables, and the radius is as wide, as that needs.

Defined results: null vectors, zero vectors and vectors with null or non-finite components have no links, and each is
its own component; vectors of different lengths link with nothing of another length; rows that share an id are one
vector each, with links of their own, and all of them are one in the components; a null id links with nothing (component
and kept null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, saved, small
from .components import components, forest, grouped

THRESHOLD, SAMPLE, ROUNDS, SEED, BLOCK = 0.95, 10_000, 30, 5, 2048
#: Expected classes to a bucket, from which the substrings' length follows, and tables for a recall of about 0.99.
BUCKET = 16
#: Share of the pairs at the threshold that are beyond the radius; bits whose flips hang together count as fewer.
BEYOND, EFFECTIVE = 0.001, 0.5
#: Rows of two numbers up to which a table is broadcast.
IDS = 500_000


def learn_rotations(x: np.ndarray, bits: int, count: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix of all rotations' columns): principal directions, rotated so that signs lose least."""
    dim = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(dim)
    centred = x - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / max(len(x), 1) + 1e-12 * np.eye(dim))
    base = vectors[:, np.argsort(-values)][:, : min(bits, dim)]
    low = centred @ base
    out = []
    for k in range(count):
        rng = np.random.default_rng(seed + k)
        r, _ = np.linalg.qr(rng.standard_normal((base.shape[1],) * 2))
        for _ in range(rounds if len(x) else 0):
            b = np.where(low @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(low.T @ b)
            r = u @ vt
        out.append(base @ r)
    return mean, np.concatenate(out, axis=1)


def flips(x: np.ndarray, mean: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """The probability that a bit differs between each unit vector and one at the threshold from it, both less the mean.

    The other vector is off in a direction at right angles to the vector and the mean, as most are in many dimensions.
    """
    along, size = x @ mean, mean @ mean
    norms = np.sqrt(np.maximum(1 + size - 2 * along, 0) * np.maximum(1 + size - 2 * threshold * along, 0))
    cosine = (threshold - (1 + threshold) * along + size) / np.maximum(norms, 1e-12)
    return np.arccos(np.clip(np.where(norms > 1e-9, cosine, 0), 0, 1)) / math.pi


def tables_for(classes: int, flip: float | np.ndarray = math.acos(THRESHOLD) / math.pi) -> tuple[int, int]:
    """(bits to a key, tables): keys long enough for small buckets, tables enough that a pair at the threshold is missed once in a hundred times.

    Where bits differ so often that this needs many tables, keys are shorter if larger buckets are less work than the tables.
    """
    miss = lambda bits: 1 - (1 - np.atleast_1d(flip)) ** bits

    def tables(bits: int) -> int:
        few, many = 0, 1
        while (miss(bits) ** many).mean() > 0.01:
            few, many = many, 2 * many
        while many - few > 1:
            half = (few + many) // 2
            few, many = (half, many) if (miss(bits) ** half).mean() > 0.01 else (few, half)
        return many

    bits = min(max(8, math.ceil(math.log2(max(classes, 1) / BUCKET + 1))), 30)
    plain = math.log(0.01) / math.log(1 - (1 - math.acos(THRESHOLD) / math.pi) ** bits)
    if tables(bits) > 4 * plain:
        bits = min(range(1, bits + 1), key=lambda k: tables(k) * (BUCKET + classes / 2**k))
    return bits, tables(bits)


def radius_for(bits: int, flip: float | np.ndarray) -> int:
    """The Hamming distance within which pairs at the threshold are, but one in a thousand; flips of a rotation's bits are not independent, so the spread is that of fewer bits."""
    flip = np.atleast_1d(flip)
    wide = flip * bits + 3.1 * np.sqrt(flip * (1 - flip) * bits / EFFECTIVE)
    return int(min(bits, math.ceil(np.quantile(wide, 1 - BEYOND))))


def candidates(codes: np.ndarray, masks: np.ndarray, table: int, radius: int, left: np.ndarray | None = None, strip: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), by strips: the pairs of codes within the radius that meet in no table before this one. left: a mask of one block; only pairs across are looked at."""
    a = np.flatnonzero(left) if left is not None else np.arange(len(codes))
    b = np.flatnonzero(~left) if left is not None else a
    for at in range(0, len(a), strip):
        part = a[at : at + strip]
        apart = np.zeros((len(part), len(b)), np.int32)
        for w in range(codes.shape[1]):
            apart += np.bitwise_count(codes[part, w][:, None] ^ codes[b, w][None, :])
        i, j = np.nonzero(apart <= radius)
        i, j = part[i], b[j]
        if left is None:
            i, j = i[i < j], j[i < j]
        for u in range(table):
            first = (((codes[i] ^ codes[j]) & masks[u]) != 0).any(axis=1)
            i, j = i[first], j[first]
        yield i, j


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, without an overflow."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def link_counts(vectors: np.ndarray, weight: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Sums of the weights of the linked classes, and the linked pairs' forest, of candidates among unit vectors."""
    n = len(vectors)
    links, roots, ends = np.zeros(n), [np.zeros(0, int)], [np.zeros(0, int)]
    for i, j in pairs:
        a, of_a = np.unique(i, return_inverse=True)
        b, of_b = np.unique(j, return_inverse=True)
        if len(a) * len(b) <= 8 * len(i):  # most of a strip: one product
            cosine = (vectors[a] @ vectors[b].T)[of_a, of_b]
        else:
            cosine = np.einsum("ij,ij->i", vectors[i], vectors[j])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        links += np.bincount(i, weights=weight[j], minlength=n) + np.bincount(j, weights=weight[i], minlength=n)
        root = forest(n, (i, j))
        moved = np.flatnonzero(root != np.arange(n))
        roots.append(moved)
        ends.append(root[moved])
    return links, (np.concatenate(roots), np.concatenate(ends))


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    rows = picked(vectors, {"vec_id": vec_id, "embedding": embedding})
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    when = lambda c: F.when(F.col("sound"), c)
    rows = saved(rows.withColumn("sound", sound).select("vec_id", "sound", F.monotonically_increasing_id().alias("row"), when(F.xxhash64("embedding")).alias("high"), when(F.xxhash64(F.lit(1), "embedding")).alias("low"), "embedding"), "rows")
    same = ["high", "low"]
    # a class is named by its first row, whose vector it has
    classes = saved(rows.where("sound").groupBy(*same).agg(F.min("row").alias("id"), F.min("vec_id").alias("rep"), F.count("*").cast("long").alias("weight")), "classes")
    own = saved(rows.join(small(classes.select(F.col("id").alias("row"), "weight"), IDS), "row").select(F.col("row").alias("id"), "weight", F.size("embedding").alias("dim"), "embedding"), "vectors")
    found = None
    for dim, many in sorted((r[0], r[1]) for r in own.groupBy("dim").count().collect()):
        some = _links(own.where(F.col("dim") == dim).drop("dim"), dim, many, threshold, sample, block)
        found = some if found is None else found.union(some)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    edges = found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))
    # classes that hold rows of one id are one in the components
    of_row = rows.where("sound").select("vec_id", *same).groupBy("vec_id", *same).agg(F.lit(1).alias("one")).drop("one")
    shared = of_row.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    held = saved(of_row.join(small(saved(shared, "shared"), IDS), "vec_id").join(classes, same).select("vec_id", "id"), "held")
    edges = edges.union(held.join(held.groupBy("vec_id").agg(F.min("id").alias("b")), "vec_id").select(F.col("id").alias("a"), "b"))
    comp = saved(components(edges), "components")
    sums = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    facts = classes.join(sums, "id", "left").join(small(comp, IDS), "id", "left").withColumn("component", F.coalesce("component", "id"))
    facts = saved(facts, "facts")
    facts = facts.join(facts.groupBy("component").agg(F.min("rep").alias("component_id")), "component")
    facts = facts.select(*same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id")
    out = rows.join(facts, same, "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(own: DataFrame, dim: int, many: int, threshold: float, sample: int, block: int) -> DataFrame:
    """id, links, to: sums of links (to is null) and edges (links is null) among classes (id, weight, embedding) of one length."""
    got = own.orderBy(F.xxhash64("embedding"), "id").limit(sample).select("embedding").toArrow()
    x = unit(np.array(got["embedding"].to_pylist(), dtype=float).reshape(-1, dim))
    flip = flips(x, x.mean(axis=0), threshold)
    bits, tables = tables_for(many, flip)
    per = max(1, dim // bits) if dim >= bits else 1
    mean, rotation = learn_rotations(x, dim, math.ceil(tables * bits / max(dim, 1)) if dim < bits else math.ceil(tables / per))
    if dim >= bits:
        cols = np.concatenate([k * dim + p * bits + np.arange(bits) for k in range(rotation.shape[1] // dim) for p in range(per)][:tables])
    else:
        cols = np.arange(tables * bits) % rotation.shape[1]
    # the code is the tables' keys, one after the other
    width = -(-len(cols) // 64)
    powers = 1 << np.arange(bits, dtype=np.int64)
    masks = np.zeros((tables, width * 64), np.uint8)
    for t in range(tables):
        masks[t, t * bits : (t + 1) * bits] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")
    radius = radius_for(len(cols), flip)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit(batch.column(1).flatten().to_numpy().astype(float).reshape(-1, dim))
            signs = ((v - mean) @ rotation >= 0)[:, cols]
            keys = signs.reshape(len(v), tables, bits) @ powers
            code = np.packbits(np.pad(signs, ((0, 0), (0, width * 64 - len(cols)))), axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(keys.astype(np.int64)), pa.list_(pa.int64()))], ["id", "code", "keys"])

    codes = saved(own.select("id", "embedding").mapInArrow(coded, "id long, code binary, keys array<long>"), "codes")
    each = codes.select("id", "code", F.posexplode("keys").alias("table", "key"))
    # only buckets of two classes or more are met; the larger are dealt out as pairs of blocks
    counts = saved(each.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    dealt = F.ceil(F.col("n") / block).cast("int")
    met = each.join(small(counts), ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), dealt).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), dealt - 1)))
    met = met.select("id", "code", "table", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    at = ["table", "key", "x", "y"]

    def pairs_of(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        code = np.frombuffer(b"".join(group["code"].to_pylist()), "<u8").reshape(group.num_rows, width)
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        return candidates(code, masks, group["table"][0].as_py(), radius, group["own"].to_numpy() == x if x != y else None)

    def active(group: pa.Table) -> Iterator[pa.RecordBatch]:
        some = np.zeros(group.num_rows, bool)
        for i, j in pairs_of(group):
            some[i] = some[j] = True
        if some.any():
            yield from group.filter(pa.array(some)).combine_chunks().to_batches()

    def compare(group: pa.Table) -> Iterator[pa.RecordBatch]:
        v = unit(group["embedding"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dim))
        ids = group["id"].to_numpy()
        links, (a, b) = link_counts(v, group["weight"].to_numpy().astype(float), pairs_of(group), threshold)
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array([None] * len(some), pa.int64())], ["id", "links", "to"])
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array([None] * len(a), pa.int64()), pa.array(ids[b])], ["id", "links", "to"])

    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    near = saved(grouped(met, at, parts, active, met.schema), "active")
    return saved(grouped(near.join(own, "id"), at, parts, compare, "id long, links long, to long"), "links")
