"""Dense features of whole texts, computed from their bytes, for the classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textbytes import LOWER, SPACE, chunks, counts_by_row, slice_hashes, words

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_CONT = np.zeros(256, bool)
_CONT[128:192] = True


def _of(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_STOP, _LOUD, _LINK, _SYMBOL = _of(".,;:'\"()-"), _of("!?"), _of("|/\\<>=_~^[]{}"), _of("#$%&*@+")
_NEWLINE = _of("\n")

QUALITY = (
    "log_words", "mean_word", "upper", "digit", "high", "stop", "loud", "link", "symbol", "space", "distinct", "repeat_next", "repeat_line", "words_per_line",
    "short_words", "long_words", "tail_symbol", "upper_words", "lone_marks", "loud_words", "any_symbol", "any_repeat",
)


def _rows_sum(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=value, minlength=n)[:n]


def quality_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, matrix) by chunks: one row of QUALITY for each text."""
    for a, b, data, offsets in chunks(column):
        n = b - a
        size = np.maximum(np.diff(offsets), 1).astype(float)
        start, end, row = words(data, offsets)
        length = (end - start).astype(float)
        count = np.bincount(row, minlength=n)[:n].astype(float)
        many = np.maximum(count, 1)
        share = {k: counts_by_row(t[data], offsets) / size for k, t in (("upper", _UPPER), ("digit", _DIGIT), ("high", _HIGH), ("stop", _STOP), ("loud", _LOUD), ("link", _LINK), ("symbol", _SYMBOL), ("space", SPACE))}
        h = slice_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64)
        same_row = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
        repeat = same_row & (np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else same_row)
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])]) if len(hs) else np.zeros(0, bool)
        line_start, line_end, line_row = words(data, offsets, _NEWLINE)
        lh = slice_hashes(data, line_start, line_end) if len(line_start) else np.zeros(0, np.uint64)
        order = np.lexsort((lh, line_row))
        ls, lr = lh[order], line_row[order]
        line_again = np.concatenate([[False], (ls[1:] == ls[:-1]) & (lr[1:] == lr[:-1])]) if len(ls) else np.zeros(0, bool)
        lines = np.maximum(np.bincount(line_row, minlength=n)[:n], 1).astype(float)
        last, first = (data[end - 1], data[start]) if len(start) else (np.zeros(0, np.uint8),) * 2
        tail = _rows_sum(row, _SYMBOL[last], n) / many
        shout = _rows_sum(row, (_UPPER[first] & ((end - start) > 1) & (_UPPER[data[np.minimum(start + 1, len(data) - 1)]])) if len(start) else np.zeros(0), n) / many
        lone = _rows_sum(row, (length == 1) & (_LINK[first] | _SYMBOL[first]), n) / many
        loud = _rows_sum(row, _LOUD[last], n) / many
        again = _rows_sum(row, repeat, n)
        yield a, b, np.column_stack([
            np.log1p(count), _rows_sum(row, length, n) / many, share["upper"], share["digit"], share["high"], share["stop"], share["loud"], share["link"], share["symbol"], share["space"],
            _rows_sum(rs, new, n) / many, again / many, _rows_sum(lr, line_again, n) / lines, np.log1p(count / lines),
            _rows_sum(row, length <= 2, n) / many, _rows_sum(row, length >= 12, n) / many, tail, shout, lone, loud,
            np.sqrt(share["symbol"]), np.sqrt(again / many),
        ])


#: What a character stands for when a word is disguised, and words that address the reader.
DISGUISE = str.maketrans("013457@$!|", "oieastasii")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta vous votre vos tú ti tus usted vosotros vuestro".split())
STEMS = (4, 5)
NEAR = 4
_WORD = re.compile(r"[^\s]+")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_INSIDE = re.compile(r"[^\w]+|_+")
_DISGUISED = re.compile(r"[0-9@$!|*.\-_]")

TOXIC = ("hits", "any_hit", "log_hits", "strongest", "mean_weight", "stem_rate", "log_stems", "best_stem", "near_you", "you", "upper", "loud", "stop", "symbol", "disguised", "unmasked", "log_unmasked", "log_words", "top_rate", "either_rate")


def plain(word: str) -> str:
    """The word without the marks around it, in lower case."""
    return _EDGE.sub("", word.lower())


def unmasked(word: str) -> str:
    """The word with disguising characters undone: l0s3r and l-o-s-e-r are loser."""
    return _INSIDE.sub("", word.translate(DISGUISE))


def toxicity_features(column: pa.Array, lexicon: dict[str, float], stems: dict[str, float]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, matrix) by chunks: one row of TOXIC for each text. lexicon, stems: weights of words and of word beginnings."""
    memo: dict[bytes, tuple] = {}
    for a, b, data, offsets in chunks(column):
        n = b - a
        size = np.maximum(np.diff(offsets), 1).astype(float)
        start, end, row = words(data, offsets)
        count = np.bincount(row, minlength=n)[:n].astype(float)
        many = np.maximum(count, 1)
        out = np.zeros((n, len(TOXIC)))
        if len(start):
            low = LOWER[data]
            h = slice_hashes(low, start, end)
            kinds, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            raw = low.tobytes()
            table = np.zeros((len(kinds), 5))
            for k, i in enumerate(first.tolist()):
                key = raw[start[i] : end[i]]
                found = memo.get(key)
                if found is None:
                    word = plain(key.decode("utf-8", "replace"))
                    masked = len(word) > 2 and _DISGUISED.search(word) is not None
                    bare = unmasked(word) if masked else word
                    found = (lexicon.get(word, 0.0), max(stems.get(word[:k], 0.0) for k in STEMS), word in SECOND_PERSON, masked and any(c.isalpha() for c in word), 0.0 if not masked or word in lexicon else lexicon.get(bare, 0.0))
                    if len(memo) < 200_000:
                        memo[key] = found
                table[k] = found
            v = table[inverse]
            hit = v[:, 0] > 0
            hits, stem_hits, un = _rows_sum(row, hit, n), _rows_sum(row, v[:, 1] > 0, n), _rows_sum(row, v[:, 4] > 0, n)
            near = np.zeros(len(row), bool)
            bad = hit | (v[:, 4] > 0)
            for gap in range(1, NEAR + 1):
                ok = row[gap:] == row[:-gap]
                near[gap:] |= ok & (v[:-gap, 2] > 0) & bad[gap:]
                near[:-gap] |= ok & (v[gap:, 2] > 0) & bad[:-gap]
            strongest, best_stem = np.zeros(n), np.zeros(n)
            np.maximum.at(strongest, row, np.maximum(v[:, 0], v[:, 4]))
            np.maximum.at(best_stem, row, v[:, 1])
            weight = _rows_sum(row, np.maximum(v[:, 0], v[:, 4]), n)
            out = np.column_stack([
                hits / many, hits > 0, np.log1p(hits), strongest, weight / many, stem_hits / many, np.log1p(stem_hits), best_stem, _rows_sum(row, near, n) / np.maximum(hits, 1), _rows_sum(row, v[:, 2], n) / many,
                counts_by_row(_UPPER[data], offsets) / size, counts_by_row(_LOUD[data], offsets) / size, counts_by_row(_STOP[data], offsets) / size, counts_by_row(_SYMBOL[data], offsets) / size,
                _rows_sum(row, v[:, 3], n) / many, un / many, np.log1p(un), np.log1p(count), weight / np.maximum(hits + un, 1), _rows_sum(row, hit | (v[:, 1] > 0), n) / many,
            ]).astype(float)
        yield a, b, out
