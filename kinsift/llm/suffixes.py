"""Suffixes in order: the solver of suffix-array deduplication.

Contexts of a piece are sorted twice by a multikey sort, by what begins with the anchor and by what precedes it
(from the anchor backwards); the lengths shared with the neighbour in each order give, for every place of
the anchor in a window, classes of equal sides. Contexts in the same two classes share the window.
"""

from __future__ import annotations

import numpy as np

from .windows import Piece, Unit


def multikey(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the rows of x (columns of eight bytes or of words) within groups, all
    partitions of a level at once: only rows that are equal in a column go on to the next. Returns the order and, for each place, the number of
    leading columns shared with the row before (0 at the start of a group)."""
    n, width = x.shape
    order = np.argsort(group, kind="stable")
    g = group[order]
    tie = np.concatenate(([False], g[1:] == g[:-1])) if n else np.zeros(0, bool)
    lcp = np.zeros(n, np.int64)
    for c in range(width):
        idx = np.flatnonzero(tie | np.concatenate((tie[1:], [False])))
        if not len(idx):
            break
        part = np.cumsum(~tie)[idx]
        key = x[order[idx], c]
        sub = np.lexsort((key, part))
        order[idx] = order[idx[sub]]
        key, part = key[sub], part[sub]
        same = np.zeros(len(idx), bool)
        same[1:] = (part[1:] == part[:-1]) & (key[1:] == key[:-1])
        tie = np.zeros(n, bool)
        tie[idx] = same
        lcp[tie] = c + 1
    return order, lcp


def wide(rows: list[np.ndarray], dtype) -> np.ndarray:
    """Rows of different lengths as a matrix; a whole number of eight-byte columns."""
    lengths = np.array([len(r) for r in rows], np.int64)
    width = max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(rows), width if dtype is np.uint64 else -(-width // 8) * 8), dtype)
    if lengths.sum():
        r = np.repeat(np.arange(len(rows)), lengths)
        c = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[r, c] = np.concatenate(rows)
    return out


def ranked(rows: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of rows within groups, the units shared with the row before, where groups start."""
    dtype = np.uint64 if rows[0].dtype == np.uint64 else np.uint8
    x = wide(rows, dtype)
    order, lcp = multikey(x if dtype is np.uint64 else x.view(">u8").astype(np.uint64), group)
    start = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    if dtype is np.uint8:  # the exact number of bytes
        diff = x[order[1:]] != x[order[:-1]]
        lcp = np.concatenate(([0], np.where(diff.any(axis=1), diff.argmax(axis=1), x.shape[1])))
        lcp[start] = 0
    return order, lcp, start


def shared(piece: Piece, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """hit: windows that another context of the group has too. on: one context of each class of equal windows."""
    m, w, la = len(piece.group), unit.window, piece.mini
    hit, on = np.zeros(piece.open.shape, bool), np.zeros(piece.open.shape, bool)
    sides = [ranked([c[:k][::-1] for c, k in zip(piece.codes, la, strict=True)], piece.group), ranked([c[k:] for c, k in zip(piece.codes, la, strict=True)], piece.group)]
    rows, at = np.nonzero(piece.open)
    a_of = la[rows] - at
    by_a = np.argsort(a_of, kind="stable")
    rows, a_of = rows[by_a], a_of[by_a]
    cuts = np.flatnonzero(np.diff(a_of, prepend=-1))
    for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
        a, idx = int(a_of[begin]), rows[begin:end]
        cls = []
        for (order, lcp, start), need in zip(sides, (a, w - a), strict=True):
            c = np.empty(m, np.int64)
            c[order] = np.cumsum(start | (lcp < need))
            cls.append(c)
        _, index, inverse, times = np.unique(cls[0][idx] * (m + 1) + cls[1][idx], return_index=True, return_inverse=True, return_counts=True)
        twice = idx[times[inverse] > 1]
        hit[twice, la[twice] - a] = True
        first = idx[index]
        on[first, la[first] - a] = True
    return hit, on
