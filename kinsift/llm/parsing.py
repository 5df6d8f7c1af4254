"""Relative Lempel-Ziv parsing: the solver of substring deduplication.

The reference of an anchor is the text around it in all documents so far, each window once, in a suffix automaton.
Documents come in order of their id. What a document has around the anchor is
factored greedily: from where the last factor has ended, the longest string that the reference has, or a word that it
doesn't have. Windows inside a factor are duplicates. A window that the reference has may also lie across the
boundary of two factors, so every boundary whose factors are long enough together is checked: the
automaton goes on over it by suffix links, and tells the longest string of the reference that ends at each word.
What has not been there before is then added to the reference.
"""

from __future__ import annotations

import numpy as np

from .windows import Piece, Unit


class Reference:
    """A suffix automaton of strings of words that grows."""

    __slots__ = ("length", "link", "next")

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the strings of q that end with those of p and c."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, words: list[int]) -> None:
        following, link, length = self.next, self.link, self.length
        last = 0
        for c in words:
            q = following[last].get(c)
            if q is not None:  # the reference has it already
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def factor(self, words: list[int], at: int) -> tuple[int, int]:
        """Length of the longest string of the reference that starts at `at`, and its state."""
        state, end, n, following = 0, at, len(words), self.next
        while end < n:
            q = following[state].get(words[end])
            if q is None:
                break
            state, end = q, end + 1
        return end - at, state

    def parse(self, words: list[int], window: int) -> tuple[list[tuple[int, int]], list[int]]:
        """The factors (start, length; 0 for a word that the reference doesn't have) and the windows that it has."""
        factors, hits, at = [], [], 0
        states = []
        while at < len(words):
            length, state = self.factor(words, at)
            factors.append((at, length))
            states.append(state)
            hits.extend(range(at, at + length - window + 1))
            at += max(1, length)
        for (start, length), (_, more), state in zip(factors, factors[1:], states, strict=False):
            if length and more and length + more >= window:
                hits.extend(self.across(words, start + length, length, more, state, window))
        return factors, hits

    def across(self, words: list[int], boundary: int, before: int, after: int, state: int, window: int) -> list[int]:
        """Windows of the reference that begin before the boundary of two factors and end behind it."""
        found, length = [], before
        for end in range(boundary, boundary + after):
            c = words[end]
            while c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state][c]
            length += 1
            if end + 1 - length >= boundary:
                break
            if length >= window and end + 1 - window < boundary:
                found.append(end + 1 - window)
        return found


def factored(piece: Piece, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """hit: windows that a smaller id of the group has. on: those that none has in this piece."""
    hit = np.zeros(piece.open.shape, bool)
    m, w = len(piece.group), unit.window
    k = 0
    while k < m:
        stop = k + 1
        while stop < m and piece.group[stop] == piece.group[k]:
            stop += 1
        reference, at = Reference(), k
        while at < stop:
            same = at + 1  # contexts of one id are not before each other
            while same < stop and piece.doc[same] == piece.doc[at]:
                same += 1
            new = []
            for j in range(at, same):
                words = piece.codes[j].tolist()
                if at > k:
                    hit[j, reference.parse(words, w)[1]] = True
                if same < stop:
                    left = np.flatnonzero(piece.open[j] & ~hit[j])
                    cuts = np.flatnonzero(np.diff(left) > 1) + 1
                    new += [words[run[0] : run[-1] + w] for run in np.split(left, cuts) if len(run)]
            for run in new:
                reference.add(run)
            at = same
        k = stop
    return hit, ~hit
