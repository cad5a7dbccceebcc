"""Vectorised work on Arrow text columns: words, hashes and counts over the raw UTF-8 bytes of many rows at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: The low n bytes of a number of eight, for n from 0 to 8; bytes from which a slice is hashed by itself.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG = 64


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about `most` bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of bytes that aren't spaces, within a row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~space[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], the same wherever the slice stands.

    Eight bytes at a time are put in and mixed; what is longer than LONG bytes is hashed by BLAKE2.
    """
    at, size = eights(data), end - start
    with np.errstate(over="ignore"):
        out = mix(mix((size.astype(np.uint64) + np.uint64(1)) * M1) ^ (at[start] & LOW[np.minimum(size, 8)]))
        live = np.flatnonzero((size > 8) & (size <= LONG))
        for k in range(8, LONG, 8):
            if not len(live):
                break
            out[live] = mix(out[live] ^ (at[start[live] + k] & LOW[np.minimum(size[live] - k, 8)]))
            live = live[size[live] > k + 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def equal_slices(a: np.ndarray, start: np.ndarray, b: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from `start` are the same as those from `other`; a and b are the eights of two arrays of bytes."""
    out = ((a[start] ^ b[other]) & LOW[np.minimum(size, 8)]) == 0
    live, k = np.flatnonzero(out & (size > 8)), 8
    while len(live):
        out[live] = ((a[start[live] + k] ^ b[other[live] + k]) & LOW[np.minimum(size[live] - k, 8)]) == 0
        k += 8
        live = live[out[live] & (size[live] > k)]
    return out


def counts_by_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are in the mask."""
    sums = np.empty(len(mask) + 1, dtype=np.int64)
    sums[0] = 0
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
