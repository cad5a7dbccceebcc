"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed, k-grams of word hashes are hashed, and of each sliding window of k-grams the least hash is kept as a
fingerprint. Windows of ``SPAN`` - ``GRAM`` + 1 k-grams span ``SPAN`` words, so a document and an item that share SPAN
consecutive words share a fingerprint: no shared span of that length is missed. Fingerprints join documents with
items; hits are then extended: in the documents that a fingerprint points to, every window of SPAN words is compared
with the item's windows word by word, and the words of all equal windows are hit.

An item of fewer words than SPAN is a single window of its own length; for each such length that occurs, documents also
get k-grams of that length in windows of one, which keeps all of them.

Documents are cut into words once: that pass counts the words and meets the fingerprints, and writes one row for each
document and one for each fingerprint that an item has. Fingerprints of the benchmark are broadcast only if a count shows
that they are few, and join by shuffle otherwise; else documents without a match are never shuffled. A passage that a third
of all documents hold meets only its own window's row, and items that share a window meet the documents' distinct windows.

Defined results: null and empty texts have no words and no hits; items without words have no window; a document's
repeated rows (equal id and text) are each returned, and rows that share an id but not a text are told apart; items
that share an id count once by that id, and the windows of one without an id are hit but not named; empty tables give no rows or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, picked, saved, small

SPAN, GRAM = 10, 5
#: What stands between words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased. Cutting there costs a tenth of extracting the words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def _upto(array: str, n: int) -> Column:
    """The places in an array column from which n values follow. To be exploded as outer: an inner explode would make the optimiser test the array's size with the words' whole expression in place of its name."""
    return F.when(F.size(array) >= n, F.sequence(F.lit(0), F.size(array) - n)).otherwise(F.array().cast("array<int>"))


def fingerprints(df: DataFrame, kinds: list[tuple[int, int]]) -> DataFrame:
    """df with f in place of the words w: the distinct fingerprints of all kinds (span, gram). A window of one k-gram keeps them all."""
    df = df.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).drop("w")
    for span, gram in kinds:
        df = df.withColumn(f"g{span}", F.transform(_upto("h", gram), lambda i: F.xxhash64(F.lit(span), *[F.get(F.col("h"), i + k) for k in range(gram)])))  # noqa: B023
        if (wide := span - gram + 1) > 1:
            df = df.withColumn(f"g{span}", F.transform(_upto(f"g{span}", wide), lambda i: F.least(*[F.get(F.col(f"g{span}"), i + k) for k in range(wide)])))  # noqa: B023
    made = [f"g{span}" for span, _ in kinds]
    return df.withColumn("f", F.array_distinct(F.concat(*made) if made else F.array().cast("array<bigint>"))).drop("h", *made)


def windows(df: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """One row per window of each length in the words w: keys, n, at, window (its words with spaces between)."""
    out = None
    for n in lengths:
        at = df.select(*keys, "w", F.explode_outer(_upto("w", n)).alias("at")).where("at is not null")
        at = at.select(*keys, F.lit(n).alias("n"), "at", F.concat_ws(" ", *[F.get("w", F.col("at") + k) for k in range(n)]).alias("window"))
        out = at if out is None else out.unionByName(at)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    d = picked(docs, {"doc_id": doc_id, "text": text})
    d = d.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    bench = saved(picked(items, {"item_id": item_id, "text": item_text}).select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0), "items")
    lengths = sorted(r[0] for r in bench.select(F.least(F.size("w"), F.lit(span)).alias("n")).distinct().collect())
    kinds = [(n, gram if n == span else n) for n in lengths]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    if not lengths:
        return d.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty.alias("items_sha256"), F.lit(False).alias("contaminated"))
    # an item shorter than the span has windows of its own length alone
    own = F.least(F.size("w"), F.lit(span))
    theirs = None
    for kind in kinds:
        some = fingerprints(bench.where(own == kind[0]), [kind]).select(F.explode_outer("f").alias("f")).where("f is not null")
        theirs = some if theirs is None else theirs.union(some)
    theirs = small(theirs.distinct()).withColumn("met", F.lit(True))
    # the one pass over all texts: a row for each document, and one for each fingerprint that an item has
    each = d.select("doc_id", "text_hash", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    each = fingerprints(each, kinds).select("doc_id", "text_hash", "n_words", F.posexplode_outer("f").alias("pos", "f"))
    each = saved(each.join(theirs, "f", "left").where("met or pos is null or pos = 0").select("doc_id", "text_hash", "n_words", "pos", "met"), "met")
    counted = each.where("pos is null or pos = 0").select("doc_id", "text_hash", "n_words")
    # the documents that a fingerprint points to, with their texts: mostly few, so their ids are sent out if counted so
    pointed = small(saved(each.where("met").select("doc_id", "text_hash").distinct(), "pointed"))
    near = d.join(pointed, d["doc_id"].eqNullSafe(pointed["doc_id"]) & (d["text_hash"] == pointed["text_hash"]), "left_semi")
    near = near.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    wanted = None
    for n in lengths:
        some = windows(bench.where(own == n), [n], "item_id")
        wanted = some if wanted is None else wanted.union(some)
    wanted = saved(wanted.groupBy("n", "window", "item_id").agg(F.lit(1).alias("one")).drop("one"), "windows")
    distinct = wanted.groupBy("n", "window").agg(F.lit(1).alias("one")).select("n", "window")
    hits = saved(windows(near, lengths, "doc_id", "text_hash").join(small(distinct), ["n", "window"], "left_semi"), "hits")
    hit = hits.select("doc_id", "text_hash", F.explode(F.expr("sequence(at, at + n - 1)")).alias("word")).groupBy("doc_id", "text_hash", "word").agg(F.lit(1).alias("one"))
    hit = hit.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    held = hits.groupBy("doc_id", "text_hash", "n", "window").agg(F.lit(1).alias("one")).join(small(wanted), ["n", "window"]).withColumn("item", F.col("item_id").cast("string"))
    held = held.where("item is not null").groupBy("doc_id", "text_hash", "item").agg(F.lit(1).alias("one"))
    held = held.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ",").cast("binary"), 256).alias("items_sha256"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    # an item without an id has windows, and no name among the items
    totals = hit.join(held, same(hit, held), "left").select(hit["doc_id"], hit["text_hash"], "n_hit", "n_items", "items_sha256")
    totals = small(saved(totals, "contaminated"))
    return counted.join(totals, same(counted, totals), "left").select(
        counted["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", empty).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
