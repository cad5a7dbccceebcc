"""Hashes of slices: texts made to collide under polynomial hashes don't, and pieces of one hash are told apart."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import packing, textbytes
from tessera.llm.jaccard_join import groups
from tessera.llm.kneser_ney import tokens
from tessera.llm.op7 import vocabulary
from tessera.llm.shingles import shingle_rows


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [8, 16, 64, 128, 1024, 4096])
def test_thue_morse_words_have_their_own_hashes(n):
    a, b = thue_morse(n), thue_morse(n, 1)
    data = np.frombuffer(f"{a} {b} {a}".encode(), np.uint8)
    h = textbytes.slice_hashes(data, np.array([0, n + 1, 2 * n + 2]), np.array([n, 2 * n + 1, 3 * n + 2]))
    assert h[0] == h[2] != h[1]
    found = [x for _, _, x, _ in tokens(pa.array([a, b]))]
    assert len(np.unique(np.concatenate(found))) == 3  # two words and the end
    sets = [s for _, _, s, _ in shingle_rows(pa.array([f"{a} x", f"{b} x"]))]
    assert len(np.unique(np.concatenate(sets))) == 2


def test_thue_morse_documents_are_not_linked(spark):
    docs = spark.createDataFrame([(k, " ".join([thue_morse(1024, k)] * 6)) for k in (0, 1)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in groups(docs).collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("hashes", [lambda n: np.zeros(n, np.uint64), lambda n: np.arange(n, dtype=np.uint64) % np.uint64(3)])
def test_pieces_of_one_hash_have_their_own_ids(monkeypatch, hashes):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    whole.encode_special_tokens = True
    monkeypatch.setattr(packing, "slice_hashes", lambda data, start, end: hashes(len(start)))
    encode = packing.Encoder(vocabulary())
    texts = [thue_morse(1024), thue_morse(1024, 1), "a quick, brown fox.\nIt's here", "", "word word word", "a much longer piece " + "x" * 300 + " " + "x" * 299 + "y"]
    for _ in range(2):
        for row, ids in encode(pa.array(texts)):
            assert ids.tolist() == whole.encode(texts[row], add_special_tokens=False).ids


def test_pieces_between_sure_cuts_are_the_tokenisers(monkeypatch):
    import random

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    whole.encode_special_tokens = True
    rng, some = random.Random(1), "ab'sAé.,;:!?()\"\n \t\r1_- 　ßШ中😀́\x0b\x1c"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(3000)]
    encode = packing.Encoder(vocabulary(), most=500)
    for row, ids in encode(pa.array(texts)):
        assert ids.tolist() == whole.encode(texts[row], add_special_tokens=False).ids
