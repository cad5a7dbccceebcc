"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Documents are tokenised and packed online, in the order of their input split, by the task that reads them: nothing is
shuffled and no state is shared. What a document has beyond whole windows is placed into the fill level that
minimises the sum of squared counts of partially filled windows; a level array holds the open windows of each level.
A remainder that fits no open window, or for which a new window gives the least sum, opens one. At the end of a
task the emptiest open windows are cut into the gaps of the fullest until one at most is partly full, and that one is
cut into windows whose lengths are powers of two, so that no padding is left.

Tasks number their sequences from their split's number, so a task that is run again gives the same rows. Memory is
bounded by the open windows, of which there are at most ``OPEN`` at once: beyond it the fullest one is closed by
cutting the emptiest into its gap.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no
rows; the special tokens' strings within a text are ordinary text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import picked
from .textbytes import chunks, eights, equal_slices, slice_hashes

LENGTH, END, OPEN = 2048, 1, 4096
#: Pieces that a worker remembers; beyond it, or 8 ids or 16 bytes to a piece, it starts anew.
MEMO = 750_000
#: Pieces that are held by themselves until they are put in order among the others, and bytes of text that are worked on at once.
FRESH, PART = 50_000, 1 << 19
#: Pieces that the tokeniser gets at once.
ENCODED = 2048


#: Bytes that surely begin a character that isn't white space, so that a space before them begins a piece.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True
#: Letters, and marks that no piece has behind one; an apostrophe may begin a contraction.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[[ord(c) for c in ".,;:!?()\""]] = True


def piece_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which the pre-tokeniser surely cuts, those between texts among them."""
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = _LETTER[data[:-1]] & _MARK[data[1:]]
    solid = _SOLID[data]
    cut[:-2] |= (data[:-1] == 32) & solid[1:]
    line = np.flatnonzero((data[1:-1] == 10) & solid[:-2] & solid[2:]) + 1
    cut[line] = cut[line + 1] = True
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts by a byte-level BPE file, remembering the ids of the pieces between spaces.

    The byte-level pre-tokeniser always cuts before a space that a character other than white space follows, between a
    letter and a mark, and on both sides of a line's end that has such characters on both; so the ids of such pieces are
    the text's. Pieces are found by 64-bit hashes and then compared by their bytes, so that two pieces of one
    hash have each their own ids; only those not met before reach the tokeniser.
    """

    def __init__(self, path: str, most: int = MEMO) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most
        self.forget()

    def forget(self) -> None:
        # hashes in order with their pieces' numbers, and those that are yet to be put among them
        self.hashes, self.kinds, self.fresh = np.zeros(0, np.uint64), np.zeros(0, np.int32), {}
        # of each piece: where its ids and bytes begin; the last entry is the next piece's
        self.ids, self.texts = Pool(np.dtype("<u4")), Pool(np.dtype(np.uint8))

    def _encoded(self, raw: list[bytes]) -> int:
        """Puts pieces into the pools; the number of the first one."""
        first = self.ids.count
        for at in range(0, len(raw), ENCODED):
            texts = raw[at : at + ENCODED]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            sizes = [len(x) for x in ids]
            self.ids.add(np.fromiter(chain.from_iterable(ids), "<u4", sum(sizes)), sizes)
            self.texts.add(np.frombuffer(b"".join(texts), np.uint8), [len(t) for t in texts])
        return first

    def _numbers(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The piece's number of each distinct hash, of which data[start:end] is a piece; those not met before are encoded."""
        if len(self.fresh) > FRESH:
            h, k = np.fromiter(self.fresh, np.uint64, len(self.fresh)), np.fromiter(self.fresh.values(), np.int32, len(self.fresh))
            order = np.argsort(h)
            to = np.searchsorted(self.hashes, h[order])
            self.hashes, self.kinds, self.fresh = np.insert(self.hashes, to, h[order]), np.insert(self.kinds, to, k[order]), {}
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.kinds[at[hit]]
        rest = np.flatnonzero(out < 0)
        keys = hashes[rest].tolist()
        out[rest] = [self.fresh.get(h, -1) for h in keys]
        rest = rest[out[rest] < 0]
        first = self._encoded([data[start[i] : end[i]].tobytes() for i in rest.tolist()])
        out[rest] = np.arange(first, first + len(rest))
        self.fresh.update(zip(hashes[rest].tolist(), out[rest].tolist()))
        return out

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece data[start:end] in the pools."""
        hashes, first, inverse = np.unique(slice_hashes(data, start, end), return_index=True, return_inverse=True)
        if self.ids.count > self.most or self.ids.used > 8 * self.most or self.texts.used > 16 * self.most:
            self.forget()
        out = self._numbers(hashes, start[first], end[first], data)[inverse]
        # a piece that isn't the one remembered by its hash is encoded by itself
        size, known = end - start, self.texts.sizes(out)
        same = (known == size) & equal_slices(eights(data), start, self.texts.eights(), self.texts.starts(out), np.minimum(size, known))
        other = np.flatnonzero(~same)
        if len(other):
            out[other] = self._encoded([data[start[i] : end[i]].tobytes() for i in other.tolist()]) + np.arange(len(other))
        return out

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids as unsigned little-endian 32-bit numbers) of each text."""
        for a, b, data, offsets in chunks(column, PART):
            bounds = piece_bounds(data, offsets)
            start, end = bounds[:-1], bounds[1:]
            if not len(start):
                yield from ((r, np.zeros(0, "<u4")) for r in range(a, b))
                continue
            piece = self.numbers(data, start, end)
            size = self.ids.sizes(piece)
            ends = np.cumsum(size)
            ids = self.ids.data[np.repeat(self.ids.starts(piece) - (ends - size), size) + np.arange(ends[-1])]
            # ids before each row: those of the pieces before its first one
            upto = np.concatenate([[0], ends])[np.searchsorted(start, offsets)]
            for r in range(a, b):
                yield r, ids[upto[r - a] : upto[r - a + 1]]


class Pool:
    """Numbered arrays, one after the other in one that grows."""

    def __init__(self, kind: np.dtype) -> None:
        self.data, self.bounds, self.count, self.used = np.zeros(1 << 16, kind), np.zeros(1 << 14, np.int64), 0, 0

    def add(self, values: np.ndarray, sizes: list[int]) -> None:
        """Puts in arrays of these sizes, whose values follow each other."""
        while self.count + len(sizes) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        if self.used + len(values) + 8 > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data) // 2, len(values) + 8), self.data.dtype)])
        self.data[self.used : self.used + len(values)] = values
        self.bounds[self.count + 1 : self.count + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used += len(values)
        self.count += len(sizes)

    def starts(self, numbers: np.ndarray) -> np.ndarray:
        return self.bounds[numbers]

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.bounds[numbers + 1] - self.bounds[numbers]

    def eights(self) -> np.ndarray:
        """Of bytes, as textbytes.eights: at least eight more follow the last one."""
        return np.ndarray(self.used + 1, "<u8", self.data, strides=(1,))


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


class Packer:
    """Open windows by fill level. Pieces are (row number, start, length, crc32, row's length)."""

    def __init__(self, length: int, first_id: int, most: int = OPEN) -> None:
        self.length, self.next, self.most = length, first_id, most
        self.level = np.zeros(length + 1, dtype=np.int64)
        self.windows: dict[int, list[list]] = {}
        self.count = 0
        self.done: list[tuple] = []

    def close(self, window: list) -> None:
        at = 0
        for piece in window:
            self.done.append((*piece, self.next, at))
            at += piece[2]
        self.next += 1

    def best(self, size: int) -> int:
        """The level to put a piece of this size into: 0 opens a window.

        Moving a window from level h to h + size changes the sum of squares by 2 (N[h + size] - N[h] + 1), by -2 N[h] + 1
        if it is filled; opening one, by 2 N[size] + 1. Ties go to the fuller level.
        """
        n, room = self.level, self.length - size
        cost = 2 * (n[size : self.length] - n[:room] + 1)
        cost = np.append(cost, 1 - 2 * n[room])
        cost[0] = 2 * n[size] + 1
        usable = n[: room + 1] > 0
        usable[0] = True
        cost = np.where(usable, cost, np.iinfo(np.int64).max)
        return int(len(cost) - 1 - cost[::-1].argmin())

    def _take(self, level: int) -> list:
        window = self.windows[level].pop()
        self.level[level] -= 1
        self.count -= 1
        return window

    def _put(self, window: list, level: int) -> None:
        if level == self.length:
            self.close(window)
        else:
            self.windows.setdefault(level, []).append(window)
            self.level[level] += 1
            self.count += 1

    def add(self, row: int, ids: np.ndarray) -> None:
        """Whole windows first; the remainder by the sum of squares."""
        total, whole = len(ids), len(ids) // self.length * self.length
        for at in range(0, whole, self.length):
            self.close([(row, at, self.length, zlib.crc32(ids[at : at + self.length].tobytes()), total)])
        if size := total - whole:
            level = self.best(size)
            window = self._take(level) if level else []
            window.append((row, whole, size, ids[whole:].copy(), total))
            self._put(window, level + size)
            if self.count > self.most:
                self.merge(self.most // 2)

    def merge(self, left: int) -> None:
        """Cut the emptiest windows into the gaps of the fullest until `left` are open."""
        while self.count > left:
            levels = np.flatnonzero(self.level)
            low, high = int(levels[0]), int(levels[-1])
            donor = self._take(low)
            if not self.level[high]:  # the same window
                self._put(donor, low)
                return
            into, fill = self._take(high), high
            gap = self.length - high
            while gap and donor:
                row, start, size, ids, total = donor.pop()
                part = min(size, gap)
                if part < size:  # the piece's end moves
                    donor.append((row, start, size - part, ids[: size - part], total))
                into.append((row, start + size - part, part, ids[size - part :], total))
                gap -= part
                fill += part
            self._put(into, fill)
            if rest := sum(p[2] for p in donor):
                self._put(donor, rest)

    def finish(self) -> None:
        self.merge(1)
        for level in np.flatnonzero(self.level).tolist():
            pieces, need, window = self._take(level)[::-1], 1 << (level.bit_length() - 1), []
            while pieces:
                row, start, size, ids, total = pieces.pop()
                part = min(size, need)
                window.append((row, start, part, ids[:part], total))
                if part < size:
                    pieces.append((row, start + part, size - part, ids[part:], total))
                need -= part
                level -= part
                if not need and level:
                    self.close(window)
                    need, window = 1 << (level.bit_length() - 1), []
            self.close(window)

    def take_done(self) -> list[tuple]:
        out, self.done = self.done, []
        return out


def pack(docs: DataFrame, tokenizer: str | Callable[[], str], doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: a BPE file's path on the workers, or a function that returns it there.
    """
    rows = picked(docs, {"_text": text, "doc_id": doc_id})
    kind = rows.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer() if callable(tokenizer) else tokenizer)
        packer = Packer(length, TaskContext.get().partitionId() << 36)
        tail = np.array([end], "<u4")
        names: dict[int, object] = {}  # ids of rows that have pieces in open windows
        row = 0

        def out(done: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*done))
            crc = [x if isinstance(x, int) else zlib.crc32(x.tobytes()) for x in cols[3]]
            arrays = [names_array([names[r] for r in cols[0]]), *(pa.array(x, pa.int64()) for x in (cols[1], cols[2], crc, cols[4], cols[5], cols[6]))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def names_array(values: list) -> pa.Array:
            return pa.array(values, type=id_type)

        id_type = None
        for batch in batches:
            id_type = batch.column(1).type
            id_list = batch.column(1).to_pylist()
            for at, ids in encode(batch.column(0)):
                names[row] = id_list[at]
                packer.add(row, np.concatenate([ids, tail]))
                row += 1
                if len(packer.done) > 20_000:
                    yield out(packer.take_done())
                    held = {p[0] for ws in packer.windows.values() for w in ws for p in w}
                    names = {k: v for k, v in names.items() if k in held}
        packer.finish()
        if packer.done:
            yield out(packer.take_done())

    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(work, schema)
