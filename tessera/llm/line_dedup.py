"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Two lines are linked if at most ``EDITS`` insertions, deletions or substitutions of characters make one of the other. A
line is cut into EDITS + 1 segments; of two linked lines the longer holds one of the shorter's segments whole, at a
place that the lengths and the segment's number confine. So every line is indexed by its segments and probed by the
substrings of those places for each length from its own down by EDITS, and the two meet by (length, segment,
substring). Only keys that two distinct lines share go on; the index is counted by partial sums, so the join has one row a key
on its side.

Candidates are verified by a bit-parallel edit distance over the band of 2 EDITS + 1 diagonals: one word holds the
band's states for each number of errors, and a character of the line is one step. The lines' common beginning and
end are left out of it.

A key that more than ``CROWD`` lines share gets a pivot, its least line. What is linked to the pivot is compared with no
other such line of the crowd, so that near copies cost their number and not its square; the others of the crowd are
compared with all of it within the join, which gives only what is linked. No link is lost.

Classes are the connected lines. The occurrence that comes first (least doc_id, then line number) stays; all others
of the class go. Exact copies are one line from the start, by partial sums before the shuffle.

Lines are compared without white space at their ends and with A-Z lower-cased. Lines shorter than ``LEAST`` characters
after that are never linked by edits, of which two are too loose for them; with ``short`` their exact copies are classes
like those of longer lines, without it they are left alone. Defined results: empty lines are neither linked nor removed;
a null text has no lines and stays null; a text all of whose lines go becomes empty; rows that repeat an id and a text are one occurrence and are
treated alike, rows that share only an id are told apart by their texts; a null id comes after all others; empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, picked, saved, sieved, small, unused
from .components import components

EDITS, LEAST, CROWD = 2, 20, 64
#: Characters after which a pair is given up if the band is empty.
FIRST = 8
#: Ids up to which a table of single numbers is broadcast.
IDS = 1_000_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def segment(size: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """(start from 1, length) of the i-th of edits + 1 segments of a line of this size: as even as can be, the longer ones last."""
    k = edits + 1
    base, over = F.floor(size / k).cast("int"), i - k + size % k
    return base * i + F.greatest(F.lit(0), over) + 1, base + (over >= 0).cast("int")


def places(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) of all substrings to probe.

    A segment i of a line shorter by d stands, in the longer line, shifted by s. Of the segments that match, one has an
    edit in each segment before it and after it at the least, so |s| <= i and |d - s| <= edits - i for it.
    """
    return [(d, i, s) for d in range(edits + 1) for i in range(edits + 1) for s in range(-edits, edits + 1) if abs(s) <= i and abs(d - s) <= edits - i]


def keys(distinct: DataFrame, edits: int, own: bool = False) -> DataFrame:
    """key, id, indexed: of each distinct line (id, line, size) the probes; a line's own segments are also its index. own: these alone.

    One small expression for all places, over rows of a constant array: a sum of all written out would be too long to be
    compiled. Substrings are taken from four bytes a character, where a place is found without counting up to it.
    """
    at = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in places(edits) if not own or d == s == 0])
    rows = distinct.select("id", F.encode("line", "UTF-32").alias("wide"), "size").select("id", "wide", "size", F.explode(at).alias("at"))
    rows = rows.select("id", "wide", "size", (F.col("size") - F.col("at.d")).alias("of"), F.col("at.i").alias("i"), F.col("at.s").alias("s"))
    start, length = segment(F.col("of"), F.col("i"), edits)
    rows = rows.select("id", "wide", "size", "of", "i", "s", start.alias("start"), length.alias("length"))
    first = F.col("start") + F.col("s")
    rows = rows.where((first >= 1) & (first + F.col("length") - 1 <= F.col("size")) & (F.col("of") > edits))
    part = F.substring("wide", (first - 1) * 4 + 1, F.col("length") * 4)
    return rows.select("id", F.xxhash64("of", "i", part).alias("key"), ((F.col("of") == F.col("size")) & (F.col("s") == 0)).alias("indexed"))


def within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """pairs with a column linked: whether a and b are at most `edits` apart.

    Bit o of lane e is set if the cell on diagonal o of the band is reached with e errors. On a character, a match keeps the
    diagonal; with one error more, a substitution keeps it, an insertion goes one down and a deletion one up. When
    no bit is set after the first ``FIRST`` characters, as for most lines that share but a segment, the rest is left out.
    """
    width = 2 * edits + 1
    full = F.lit((1 << width) - 1).cast("long")
    start = F.lit(sum(((1 << (e + 1)) - 1) << edits << (e * width) for e in range(edits + 1))).cast("long")

    def step(state: Column, match: Column) -> Column:
        lane = [F.shiftright(state, e * width).bitwiseAND(full) for e in range(edits + 1)]
        now = [lane[0].bitwiseAND(match)]
        for e in range(1, edits + 1):
            now.append(lane[e].bitwiseAND(match).bitwiseOR(lane[e - 1]).bitwiseOR(F.shiftright(lane[e - 1], 1)).bitwiseOR(F.shiftleft(now[e - 1], 1).bitwiseAND(full)))
        out = now[0]
        for e in range(1, edits + 1):
            out = out.bitwiseOR(F.shiftleft(now[e], e * width))
        return out

    # characters are four bytes each, so that a place is found without counting up to it
    part = lambda c, at, n: F.substring(c, at * 4 + 1, n * 4)

    def apart(x: Column, y: Column, m: Column, n: Column, head: Column) -> Column:
        """The m and n characters of x and y from head on."""

        def columns(first: Column, last: Column) -> Column:
            """The bits of the diagonals on which the characters match, for columns from first up to last."""
            at = F.when(last > first, F.sequence(first, last - 1)).otherwise(F.array().cast("array<int>"))
            one = lambda j, o: F.when((j + (o - edits) < m) & (j + (o - edits) >= 0) & (part(x, head + j + (o - edits), F.lit(1)) == part(y, head + j, F.lit(1))), F.lit(1 << o).cast("long")).otherwise(F.lit(0).cast("long"))
            return F.transform(at, lambda j: sum((one(j, o) for o in range(1, width)), one(j, 0)))

        ends = lambda state: F.getbit(state, F.lit(edits * width + edits) + m - n) == 1
        whole = lambda state: F.when(n <= FIRST, ends(state)).when(state == 0, False).otherwise(ends(F.aggregate(columns(F.lit(FIRST), n), state, step)))
        return F.when(F.abs(m - n) > edits, False).otherwise(let(F.aggregate(columns(F.lit(0), F.least(n, F.lit(FIRST))), start, step), whole))

    powers = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])

    def alike(most: Column, equal: Callable[[Column, Column], Column]) -> Column:
        """The largest number up to most so that equal(from, further) holds all the way, by halving."""
        return F.aggregate(powers, F.lit(0), lambda at, p: F.when((at + p <= most) & equal(at, p), at + p).otherwise(at))

    def linked(x: Column, y: Column) -> Column:
        m, n = (F.octet_length(x) / 4).cast("int"), (F.octet_length(y) / 4).cast("int")
        least = F.least(m, n)
        first = alike(least, lambda at, p: part(x, at, p) == part(y, at, p))
        last = lambda head: alike(least - head, lambda at, p: part(x, m - at - p, p) == part(y, n - at - p, p))
        return let(first, lambda head: let(last(head), lambda tail: apart(x, y, m - head - tail, n - head - tail, head)))

    wide = lambda c: F.encode(F.col(c), "UTF-32")
    return pairs.withColumn("linked", let(wide(a), lambda x: let(wide(b), lambda y: linked(x, y))))


def links(distinct: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """a, b: the linked lines of a table of distinct lines (id, line, size), but those that a chain of others links."""
    # a probe goes on if its key is in the index of another line; nothing but counts is made of all the index
    index = keys(distinct, edits, own=True).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    met = saved(keys(distinct, edits).join(index, "key").where("id != low or id != high"), "met", release=True)
    alone = met.where("low = high").groupBy("key", F.col("low").alias("id")).agg(F.lit(True).alias("indexed"))
    k = met.select("key", "id", "indexed").unionByName(alone)
    sizes = saved(k.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("c")), "sizes")
    k = saved(k.join(small(sizes, IDS), "key").select("key", "id", "indexed", "pivot", "c").repartition("key"), "keys")
    few, many = k.where(F.col("c") <= crowd), k.where(F.col("c") > crowd).select("key", "id", "indexed", "pivot")

    def pair(df: DataFrame) -> DataFrame:
        return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")

    def verified(df: DataFrame) -> DataFrame:
        # the lines that pairs name, picked by their ids alone: sent out if a count shows that they are few
        df = saved(df, "candidates")
        named = small(saved(df.select(F.col("a").alias("id")).union(df.select("b")).groupBy("id").agg(F.lit(1).alias("one")).select("id"), "named"), IDS)
        text = saved(distinct.select("id", "line").join(named, "id", "left_semi"), "texts")
        both = df.join(text.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(text.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
        return saved(within(both, "line_a", "line_b", edits).where("linked").select("a", "b"), "verified")

    met = few.where("indexed").select("key", F.col("id").alias("x")).join(few.select("key", F.col("id").alias("y")), "key").where("x != y")
    met = met.union(many.where("id != pivot").select("key", F.col("pivot").alias("x"), F.col("id").alias("y")))
    out = verified(pair(met.select("x", "y")))
    if many.limit(1).count():
        near = out.union(out.select("b", "a")).toDF("pivot", "id").withColumn("near", F.lit(True))
        crowd = many.where("id != pivot")
        named = small(saved(crowd.groupBy("id").agg(F.lit(1).alias("one")).select("id"), "named"), IDS)
        crowd_rows = crowd.join(near, ["pivot", "id"], "left").join(distinct.select("id", "line").join(named, "id", "left_semi"), "id").withColumn("near", F.coalesce("near", F.lit(False)))
        crowd_rows = saved(crowd_rows, "crowds")
        x, y = crowd_rows.where("not near").alias("x"), crowd_rows.alias("y")
        close = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") != F.col("y.id")) & (F.col("x.indexed") | F.col("y.indexed"))
        close &= (F.abs(F.length("x.line") - F.length("y.line")) <= edits) & (F.levenshtein(F.col("x.line"), F.col("y.line"), edits) >= 0)
        out = out.union(verified(pair(x.join(y, close).select(F.col("x.id").alias("x"), F.col("y.id").alias("y")))))
    return out


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, short: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All rows and columns of docs with the text's later lines of each class taken out, and two counts (unless docs has such columns). short: exact copies of lines under `least` go too."""
    row, gone_at, of_id, of_row = unused(docs.columns, "row", "gone", "of_id", "of_row")
    d = docs.withColumn(row, F.xxhash64(F.col(f"`{text}`")))
    each = picked(d, {"doc_id": doc_id, "row": row, "text": text}).where("text is not null")
    shortest = F.length("line") >= (1 if short else least)
    # made within the array, so that what follows has a line as it is and doesn't make it anew for each use
    split = lambda f: each.select("doc_id", "row", F.posexplode_outer(F.transform(F.split("text", "\n", -1), f)).alias("at", "line")).where(shortest)
    found = split(lambda x: trimmed(lower_ascii(x))).groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    # numbered, and found again in the texts by 64 bits of the line in lower case, which all copies share, and 64 of the line
    key, same = F.xxhash64(F.lower("line")), lambda line: F.xxhash64(F.lit(1), line)
    found = found.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("size"), "n", "first", key.alias("key"), same(F.col("line")).alias("same"))
    found = saved(found, "lines")
    comp = saved(components(links(found.where(F.col("size") >= least).select("id", "line", "size"), edits)), "components")
    classes = found.select("id", "first", "n").join(small(comp, IDS), "id", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "id"))
    classes = saved(classes, "classes")
    stays = classes.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("all")).where(F.col("all") > 1).drop("all")
    named = saved(classes.select("id", "component").join(stays, "component"), "named")
    stays = saved(found.select("id", "key", "same").join(small(named, IDS), "id").select("component", "first", "key", "same"), "stays")
    # the key is made at less cost than the line, which is made of what the key finds
    again, sent, low = split(trimmed).withColumn("key", key), small(stays), same(lower_ascii(F.col("line")))
    if sent is stays:
        again, low = sieved(again, "key", stays.select("key"), "maybe").where("maybe").select("doc_id", "row", "at", "key", low.alias("low")), F.col("low")
    hits = again.join(sent, "key").where(low.bitwiseXOR(F.col("same")) == 0).select("doc_id", "row", "at", "component", "first")
    hits = saved(hits.repartition("component", "doc_id"), "hits", release=True)
    # of the occurrences in the first document, the one that comes first stays
    own = F.col("doc_id").eqNullSafe(F.col("first"))
    stay = hits.where(own).groupBy("component").agg(F.min(F.struct("row", "at")).alias("stays"))
    gone = hits.join(small(saved(stay, "firsts"), IDS), "component").where(~own | (F.struct("row", "at") != F.col("stays")))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone"))
    gone = small(saved(gone.select(F.col("doc_id").alias(of_id), F.col("row").alias(of_row), F.col("gone").alias(gone_at)), "gone"))
    out = d.join(gone, F.col(f"`{doc_id}`").eqNullSafe(F.col(of_id)) & (F.col(row) == F.col(of_row)), "left")
    parts = F.split(F.col(f"`{text}`"), "\n", -1)
    left = let(parts, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gone_at)), lambda i: F.get(p, i)), "\n"))
    cols = [F.when(F.col(gone_at).isNull(), F.col(f"`{text}`")).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    more = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(parts)), F.coalesce(F.size(gone_at), F.lit(0))
    return out.select(*cols, *[v.cast("long").alias(k) for k, v in zip(counts, more) if k not in docs.columns])
