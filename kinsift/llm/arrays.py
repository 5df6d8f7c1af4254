"""Text columns as flat NumPy arrays.

The operators that must look at every byte or word of a corpus read Arrow's
UTF-8 buffer directly: no Python string is made for a word, and every step is one vector
operation over a slice of a few megabytes, so that memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

#: Bytes of words as `[^\x20\x09-\x0D]+` has them.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base (or of its inverse) modulo 2**64, kept between calls."""
    key, base = ("i", _PINV) if inverse else ("p", _P)
    if len(_powers[key]) < n:
        grown = np.full(max(n, SLICE_BYTES + 65536), base, np.uint64)
        grown[0] = 1
        _powers[key] = np.multiply.accumulate(grown)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes of text each (one row at least)."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin, done = 0, 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(ends, done + most, "right")))
        yield begin, end
        done, begin = int(ends[end - 1]), end


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which `spans` takes the hash of any range of `codes` at once."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges [start, end): equal ranges hash alike wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of maximal runs of bytes in `table` that stay in a row, and for
    each row the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(prefix(BYTE_CODE[data]), starts, ends)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places are inside at least one range [start, end)."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0
