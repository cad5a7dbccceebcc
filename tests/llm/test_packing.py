"""Exact round trip of packing, and the packer's rule."""

import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.op7 import vocabulary
from tessera.llm.packing import Encoder, Packer, pack


def whole(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


TEXTS = ["a  b", "\n x", " ", "", "  ", "a \n b  ", "don't  'll", "　 あ い う", "1 2  3 \t4 ", "\r\n \r\n a", "<|endoftext|> x", "é à  ü", "word " * 9000, "x" * 5000, None]


def test_ids_are_the_whole_texts():
    enc = Encoder(vocabulary())
    for text, (_, ids) in zip(TEXTS, enc(pa.array(TEXTS))):
        assert ids.tolist() == whole(text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(2, 8))
def test_packer_keeps_every_id(sizes, most):
    p = Packer(32, 0, most)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype="<u4"))
    p.finish()
    assert p.count == 0
    covered, fill = {}, {}
    for row, start, length, ids, total, seq, offset in p.done:
        assert total == sizes[row] and fill.get(seq, 0) == offset
        fill[seq] = offset + length
        covered.setdefault(row, []).append((start, length))
        want = np.arange(start, start + length, dtype="<u4").tobytes()
        assert (ids if isinstance(ids, int) else zlib.crc32(ids.tobytes())) == zlib.crc32(want)
    for row, pieces in covered.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == sizes[row]
    assert len(covered) == len(sizes)
    assert all(f & (f - 1) == 0 and f <= 32 for f in fill.values())


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(200):
        p = Packer(16, 0)
        p.level[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def cost(h):
            n = p.level.copy()
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return (n[1:16] ** 2).sum()

        usable = [0] + [h for h in range(1, 17 - size) if p.level[h]]
        assert cost(p.best(size)) == min(cost(h) for h in usable)


def test_pack(spark):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)] + [(None, "null id", "", 0)], "doc_id long, text string, start string, length int")
    rows = pack(df, vocabulary).collect()
    for i, t in enumerate(TEXTS):
        ids = np.array([*whole(t or ""), 1], "<u4")
        own = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == i)
        at = 0
        for start, length, crc, total in own:
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    assert pack(df.limit(0), vocabulary).count() == 0
