"""Connected components of an edge table, in DataFrame operations only, and grouped work on sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (the smallest id reachable): one row per id that an edge between two different ids names.

    Alternating large-star and small-star steps: every node's larger neighbours, then its smaller ones, are linked to its
    least neighbour until nothing changes, in rounds that grow with the logarithm of a component's size. Only minima
    are summed by node and joined back, so no node's neighbours are gathered, and each round is a written table. Null
    ids are left out; repeated edges and loops do no harm.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = saved(e.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), "edges")
    sums = F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))
    state = now.agg(*sums).collect()[0]
    for _ in range(MOST_ROUNDS if state[0] else 0):
        # large star: of the neighbours v of u, those over u are linked to the least of u and its neighbours
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")
        large = saved(large, "large")
        # small star: the smaller neighbours of u, and u, are linked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").union(least)
        after = saved(small.groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one"), "edges")
        before, state = state, after.agg(*sums).collect()[0]
        dropped(now)
        dropped(large)
        now = after
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("the components did not settle")
    # all edges now go from a node to its component's least
    leaves = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return leaves.union(now.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("id"), F.col("b").alias("component")))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of consecutive rows with equal keys (integers), across batches. Rows must come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        bounds = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for x, y in zip(bounds[:-1], bounds[1:]):
            key = tuple(c[x] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def forest(n: int, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest index reachable from each of n nodes, by hooking and pointer jumping over all pairs at once."""
    root = np.arange(n)
    a, b = pairs
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def grouped(df: DataFrame, keys: list[str], parts: int, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work on each group of rows with equal keys; the groups are dealt by all keys and met in sorted runs."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            yield from work(group)

    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(each, schema)
