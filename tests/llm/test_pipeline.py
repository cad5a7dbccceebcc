"""The pipeline on a small corpus: every stage against a plain version of itself, on its own input."""

import random

import corpus_pipeline as cp

from . import test_decontaminate, test_jaccard_join, test_line_dedup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "on", "st"]) for _ in range(rng.randrange(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, line(n)) for i, n in enumerate([12, 15, 20])]
    rows = []
    for i in range(60):
        rows.append([i, "\n".join(line(rng.randrange(6, 20)) for _ in range(rng.randrange(1, 6)))])
    for i in range(60, 80):
        near = rows[rng.randrange(60)][1].split(" ")
        near[rng.randrange(len(near))] = word()
        rows.append([i, " ".join(near)])
    rows += [[80, rows[3][1]], [81, rows[4][1] + "\n" + bench[0][1]], [82, line(5) + " " + bench[2][1] + " " + line(5)], [83, None], [84, ""], [85, "123 !!"]]
    return [(k, t, "en", "s", len(t) if t is not None else None) for k, t in rows], bench


def test_stages(spark, tmp_path):
    rows, bench = corpus()
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOC).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, at)
        out.write.parquet(f"{at}/{k}")
        out = spark.read.parquet(f"{at}/{k}")
        if name != "packing":
            assert out.columns == docs.columns and {f.name: f.dataType for f in out.schema} == {f.name: f.dataType for f in docs.schema}
        after = kept[name] = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()} if name != "packing" else out.collect()
        if name == "language_id":
            assert after == {i: t for i, t in before if i < 83}
        elif name == "line_dedup":
            want = {i: t for i, t, _, gone in test_line_dedup.brute(before) if not gone or (t or "").strip()}
            assert after == want
        elif name == "jaccard_join":
            assert after == {i: t for i, t in before if dict((a, c) for a, _, c in test_jaccard_join.brute(before))[i] == i}
        elif name == "decontamination":
            assert after == {i: t for i, t in before if not dict((x[0], x[5]) for x in test_decontaminate.brute(before, bench))[i]}
            assert 82 not in after
        else:
            assert {r["doc_id"] for r in after} == {i for i, _ in before}
            assert all(sum(r["length"] for r in after if r["doc_id"] == i) == next(r["doc_tokens"] for r in after if r["doc_id"] == i) for i, _ in before)
        docs = out
    ran = cp.run(spark, at)
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in ran.collect()) and ran.count() == docs.count()


def test_line_dedup_takes_copies_of_short_lines(spark):
    rows = [(1, "And ornd.\nthe first document", "en", "s", 28), (2, "And ornd.\nthe second one", "en", "s", 24)]
    out = cp.line_dedup(spark, spark.createDataFrame(rows, DOC), "")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, rows[0][1], 28), (2, "the second one", 14)]


CLASH = ["_row", "_gone", "_doc", "_of", "_text", "score", "lang_pred", "n_removed", "n_lines", "row", "gone", "component_id", "sig", "line", "hash"]


def test_stages_with_clashing_columns_null_ids_and_empty_tables(spark, tmp_path):
    """Other columns have no bearing on a stage and come back as they were; rows without an id are kept or dropped by their text."""
    rows, bench = corpus()
    rows = rows[:20] + rows[78:] + [(None, "the an er in on st the an er in on", "en", "s", 5), (3, rows[3][1], "en", "s", 1)]
    at = f"file://{tmp_path}"
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    plain = spark.createDataFrame(rows, DOC)
    wide = spark.createDataFrame([(*r, *(77 + k for k in range(len(CLASH)))) for r in rows], DOC + "".join(f", {c} long" for c in CLASH))
    for name, stage in cp.STAGES[:-1]:
        want, got = stage(spark, plain, at), stage(spark, wide, at)
        assert got.columns == wide.columns
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, got.select(*plain.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key), name
        assert all(r[c] == 77 + k for r in got.collect() for k, c in enumerate(CLASH)), name
        assert stage(spark, wide.limit(0), at).count() == 0
    assert cp.packing(spark, wide, at).count() >= len(rows) and cp.packing(spark, plain.limit(0), at).count() == 0
