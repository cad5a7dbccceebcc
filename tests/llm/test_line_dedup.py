"""Line dedup against all pairs of lines, its edit distance against the textbook's."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup as ld
from tessera.llm.common import lower_ascii

DOC = "doc_id long, text string, n_lines int, key string, line string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute(rows):
    lines = [(k, at, x, lower(x.strip(" \t\n\x0b\f\r"))) for k, t in rows if t is not None for at, x in enumerate(t.split("\n"))]
    long = sorted({b for *_, b in lines if len(b) >= ld.LEAST})
    parent = {b: b for b in long}

    def find(b):
        while parent[b] != b:
            b = parent[b]
        return b

    for i, a in enumerate(long):
        for b in long[i + 1 :]:
            if abs(len(a) - len(b)) <= ld.EDITS and distance(a, b) <= ld.EDITS:
                parent[find(a)] = find(b)
    first = {}
    for k, at, _, b in sorted(lines):
        if b in parent:
            first.setdefault(find(b), (k, at))
    out = []
    for k, t in rows:
        own = [(at, x, b) for j, at, x, b in lines if j == k]
        kept = [x for at, x, b in own if b not in parent or first[find(b)] == (k, at)]
        out.append((k, None if t is None else "\n".join(kept), len(own) if t is not None else 0, len(own) - len(kept)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcé "
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([18, 20, 21, 25, 40, 70]))) for _ in range(9)]

    def line():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(s))
            what = rng.randrange(3)
            if what == 0:
                s[at] = rng.choice(letters)
            elif what == 1:
                s.insert(at, rng.choice(letters))
            else:
                del s[at]
        out = "".join(s)
        return rng.choice([out, out.upper() if out.isascii() else out, "  " + out + "\t"])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort"), (104, rows[0][1])]


@pytest.mark.parametrize("seed,crowd", [(1, 64), (2, 3)])
def test_matches_all_pairs(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(ld.links, "__defaults__", (ld.EDITS, crowd))
    rows = corpus(seed)
    out = ld.dedup_lines(spark.createDataFrame([(k, t, None, "x", "y") for k, t in rows], DOC).drop("n_lines"))
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()) == brute(rows)


def test_distance(spark):
    rng = random.Random(4)
    pairs = []
    for i in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 12)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.choice("ab"))
            if rng.random() < 0.5 and b:
                del b[rng.randrange(len(b))]
        pairs.append((a, "".join(b)))
    for edits in (1, 2):
        got = ld.within(spark.createDataFrame(pairs, "a string, b string"), "a", "b", edits).collect()
        assert len(got) == len(pairs)
        for r in got:
            assert r["linked"] == (distance(r["a"], r["b"]) <= edits), (r["a"], r["b"])


def test_edge_cases(spark):
    assert ld.dedup_lines(spark.createDataFrame([], DOC)).count() == 0
    rows = [(None, "a line that is long enough here"), (5, "a line that is long enough here"), (5, "a line that is long enough here"), (5, "a line that is long enough hers")]
    out = ld.dedup_lines(spark.createDataFrame([(k, t, 7, "", "") for k, t in rows], DOC))
    assert out.columns == ["doc_id", "text", "n_lines", "key", "line", "n_removed"]
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in out.collect())
    kept = [g for g in got if g[1]]
    assert got[0] == (0, "", 1) and len(kept) in (1, 2) and len({g[1] for g in kept}) == 1


def test_exact_copies_of_short_lines(spark):
    rows = [(1, "And ornd.\na line that is long enough here\n\nx"), (2, " and ORND.\nAnd orne.\n\na line that is long enough hers"), (3, "And ornd.\nx\n"), (4, None)]
    out = ld.dedup_lines(spark.createDataFrame([(k, t, None, "x", "y") for k, t in rows], DOC).drop("n_lines"), short=True)
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect())
    assert got == [(1, rows[0][1], 4, 0), (2, "And orne.\n", 4, 2), (3, "", 3, 2), (4, None, 0, 0)]


def test_ids_of_any_type_and_clashing_columns(spark):
    line = "a line of more than twenty characters"
    rows = [("b", "x\n" + line, 7), ("a", line + "\nx", 8), (None, line, 9), ("a", line + "\n" + line, 10)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string, gone long")).collect()
    assert sorted(((r["doc_id"] or "", r["gone"], r["n_removed"]) for r in out)) in ([("", 9, 1), ("a", 8, 0), ("a", 10, 2), ("b", 7, 1)], [("", 9, 1), ("a", 8, 1), ("a", 10, 1), ("b", 7, 1)])


def test_a_hot_text_of_many_lines(spark):
    """One document whose every line goes, and a crowd of near lines: what is left is exact."""
    lines = [f"{i:05d} the same long line for all of them here" for i in range(300)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(lines[::-1])), (3, "another line that has nothing in common")]
    out = {r["doc_id"]: r for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[2]["n_removed"] == 300 and out[2]["text"] == "" and out[3]["n_removed"] == 0
    assert out[1]["text"] == brute(docs)[0][1]


@pytest.mark.parametrize("sent", [True, False])
def test_lines_that_case_beyond_ascii_sets_apart(spark, monkeypatch, sent):
    """Their keys are the same, and only those that are equal but for A-Z are copies; also where the lines are too many to be sent out."""
    if not sent:
        monkeypatch.setattr(ld, "small", lambda df, *a: df)
    one = "ééé ààà ççç {} the same line of letters"
    rows = [(1, one.format("ABC ŞŞŞ ÉÉÉ")), (2, one.format("abc şşş ééé")), (3, one.format("abc ŞŞŞ ÉÉÉ") + "\nİ other"), (4, "  " + one.format("Abc şşş ééé") + " "), (5, None)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id")
    assert [(r.text, r.n_removed) for r in got.collect()] == [(rows[0][1], 0), (rows[1][1], 0), ("İ other", 1), ("", 1), (None, 0)]


def test_lower_ascii_searches_only_texts_beyond_ascii(spark):
    """The search of every line took a third of the seconds of op8's two readings of the texts."""
    texts = ["ABC xyz", "ÉA éa", "éA", "İI ßẞ ΣΑΣ aΣ", "", "A\u0345ǅZ", None]
    low = lower_ascii(F.col("text"))
    got = [r.low for r in spark.createDataFrame([(t,) for t in texts], "text string").select(low.alias("low")).collect()]
    assert got == [t and lower(t) for t in texts]
    assert "octet_length(text)" in str(low)
