"""Benchmark decontamination by suffix arrays over shards of the training texts.

Words are 64-bit hashes. Each shard (a slice of a few megabytes of texts) sorts its suffixes by a multikey
sort, and every suffix of the test texts that begins a window is looked up in it by binary search: the run of
suffixes that share the window are its occurrences. Where there are any, the order is refined
as deep as ties go, test suffixes among the shard's, and the neighbours in it give the longest
verbatim match of each occurrence and where in the tests it stands. Suffixes that
begin with no pair of words of the tests can't match and are left out of the array; a
match of a single word is decided on the words themselves.

The tests go to every task, so their size is checked before they are fetched: up to `most_test_words` words in all
are one block. More are dealt out in blocks, one of which at a time is fetched and held against all texts; what it
hits is written, by digests of texts, and merged at the end. An item is not divided.

Nulls have no words; repeated rows are judged each by itself; an empty test table hits nothing. An item without an
id is a test like any other (its words are hit, its matches have no item), but is not in the list of items. Other columns
stay as they are, but for one of the name `out`, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kinsift.plans import scratch

from . import arrays as A
from .suffixes import multikey

WINDOW = 10
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
MOST_TEST_WORDS = 400_000


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and, for each row, the index of its first (one more at the end)."""
    data, offsets = A.flat(column)
    data = LOWER[data]
    starts, ends, first = A.words(data, offsets, WORD)
    return np.maximum(A.word_hashes(data, starts, ends), np.uint64(1)), first  # 0 is the end of a text


@dataclass
class Tests:
    """The words of a block of test texts, in a row."""

    tok: np.ndarray
    first: np.ndarray
    items: list
    window: int = WINDOW

    def __post_init__(self) -> None:
        n = np.diff(self.first)
        self.end = np.repeat(self.first[1:], n)
        item = np.repeat(np.arange(len(n)), n)
        need = np.minimum(n, self.window)
        here = np.arange(len(self.tok))
        keep = here + need[item] <= self.end  # every window begins a suffix
        self.start, self.need, self.item = here[keep], need[item][keep], item[keep]
        self.text = leading(self.tok, self.end, self.start, self.window)
        self.text[np.arange(self.window) >= self.need[:, None]] = 0
        # equal windows are searched for once
        order, lcp = multikey(self.text, self.need)
        new = np.flatnonzero(lcp < self.window)
        self.kind = np.empty(len(order), np.int64)  # which distinct window a suffix begins with
        self.kind[order] = np.cumsum(lcp < self.window) - 1
        self.distinct = order[new]  # one suffix of each
        self.by_kind = np.argsort(self.kind, kind="stable")
        self.kinds = np.searchsorted(self.kind[self.by_kind], np.arange(len(new) + 1))
        pair = self.start + 1 < self.end[self.start]
        self.pairs = np.unique(_pair(self.tok, self.start[pair]))
        self.pair_of = np.zeros(len(self.start), np.uint64)
        self.pair_of[pair] = _pair(self.tok, self.start[pair])
        self.single = np.unique(self.tok[self.start[self.need == 1]])

    def items_of(self, kind: int) -> set:
        own = self.by_kind[self.kinds[kind] : self.kinds[kind + 1]]
        return {self.items[k] for k in set(self.item[own].tolist())} - {None}


def leading(tok: np.ndarray, end: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first words of the suffixes at `at`; 0, which is before any word, where a text has ended."""
    if not len(at):
        return np.zeros((0, width), np.uint64)
    place = at[:, None] + np.arange(width)
    return np.where(place < end[at][:, None], tok[np.minimum(place, len(tok) - 1)], np.uint64(0))


def _pair(tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    return A.mix(tok[at] * np.uint64(3) + A.mix(tok[at + 1]))


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def bound(rows: np.ndarray, of: np.ndarray, need: np.ndarray, above: bool) -> np.ndarray:
    """Binary search of all of `of` at once in the sorted rows: the first place that isn't before (above: that is
    behind) every row that begins with the first `need` words."""
    lo, hi = np.zeros(len(of), np.int64), np.full(len(of), len(rows), np.int64)
    column = np.arange(rows.shape[1])
    while (busy := np.flatnonzero(lo < hi)).size:
        mid = (lo[busy] + hi[busy]) // 2
        own, q = rows[mid], of[busy]
        differ = (own != q) & (column < need[busy][:, None])
        at = differ.argmax(axis=1)
        k = np.arange(len(busy))
        after = np.where(differ[k, at], own[k, at] < q[k, at], above)
        lo[busy], hi[busy] = np.where(after, mid + 1, lo[busy]), np.where(after, hi[busy], mid)
    return lo


@dataclass
class Found:
    """Occurrences of test windows in a shard: place, words and kind of the window, the length of the longest
    match that begins there, and the suffix of the tests that it matches."""

    place: np.ndarray
    need: np.ndarray
    kind: np.ndarray
    length: np.ndarray
    suffix: np.ndarray


def matches(tok: np.ndarray, first: np.ndarray, tests: Tests) -> Found:
    z = np.zeros(0, np.int64)
    if not len(tok) or not len(tests.start):
        return Found(z, z, z, z, z)
    ends = np.repeat(first[1:], np.diff(first))
    here = np.flatnonzero(np.arange(len(tok)) + 1 < ends)
    pairs = _pair(tok, here)
    known = _member(pairs, tests.pairs)
    at = here[known]
    if len(tests.single):
        at = np.union1d(at, np.flatnonzero(_member(tok, tests.single)))
    if not len(at):
        return Found(z, z, z, z, z)
    rows = leading(tok, ends, at, tests.window)
    order, _ = multikey(rows, np.zeros(len(at), np.int64))
    rows, at = rows[order], at[order]
    ask = tests.distinct[(tests.need[tests.distinct] == 1) | _member(tests.pair_of[tests.distinct], np.unique(pairs[known]))]
    lo, hi = (bound(rows, tests.text[ask], tests.need[ask], above) for above in (False, True))
    n = hi - lo
    hit = np.flatnonzero(n)
    if not len(hit):
        return Found(z, z, z, z, z)
    which = np.repeat(hit, n[hit])
    place = at[np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(n[hit])[:-1])), n[hit]) + np.arange(n.sum())]
    kind = tests.kind[ask[which]]
    return Found(place, tests.need[ask[which]], kind, *longest(tok, ends, place, kind, tests))


def longest(tok: np.ndarray, ends: np.ndarray, place: np.ndarray, kind: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the words of its longest match and the test suffix that it matches: occurrences and test
    suffixes of a kind are sorted together as deep as they tie, and the nearest test suffix before or behind is it."""
    kinds = np.unique(kind)
    size = tests.kinds[kinds + 1] - tests.kinds[kinds]
    own = tests.by_kind[np.repeat(tests.kinds[kinds] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
    both, bounds = np.concatenate((tok, tests.tok)), np.concatenate((ends, tests.end + len(tok)))
    start = np.concatenate((place, tests.start[own] + len(tok)))
    group = np.concatenate((kind, tests.kind[own]))
    order = np.argsort(group, kind="stable")
    tie = np.concatenate(([False], group[order][1:] == group[order][:-1]))
    shared = np.zeros(len(order), np.int64)
    depth = 0
    while len(idx := np.flatnonzero(tie | np.concatenate((tie[1:], [False])))):
        part, at = np.cumsum(~tie)[idx], start[order[idx]] + depth
        alive = at < bounds[start[order[idx]]]
        key = np.where(alive, both[np.minimum(at, len(both) - 1)], np.uint64(0))
        sub = np.lexsort((key, part))
        order[idx] = order[idx[sub]]
        key, part, alive = key[sub], part[sub], alive[sub]
        same = np.zeros(len(idx), bool)
        same[1:] = (part[1:] == part[:-1]) & alive[1:] & (key[1:] == key[:-1])
        tie = np.zeros(len(order), bool)
        tie[idx] = same
        depth += 1
        shared[tie] = depth
    length, suffix = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for turned in (False, True):
        seq = order[::-1] if turned else order
        lcp = np.concatenate(([0], shared[::-1][:-1])) if turned else shared
        near, words = -1, 0
        for x, common in zip(seq.tolist(), lcp.tolist(), strict=True):
            words = min(words, common)
            if x >= len(place):
                near, words = x - len(place), 1 << 60
            elif near >= 0 and words > length[x]:
                length[x], suffix[x] = words, own[near]
    return length, suffix


def tests_of(rows: list, window: int = WINDOW) -> Tests:
    """rows: (item or None, text)."""
    tok, first = tokens(pa.array([r[1] for r in rows], pa.string()))
    return Tests(tok, first, [r[0] for r in rows], window)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most_test_words: int) -> tuple[DataFrame, int]:
    """The tests with the block that each is in, and the number of blocks: that of characters, which bounds that
    of words, is counted before anything is fetched."""
    b = benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("t <> ''")
    total = b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()["c"]
    n = max(1, -(-total // (2 * most_test_words)))
    return b.withColumn("b", F.pmod(F.xxhash64(F.coalesce("i", F.lit("")), "t"), F.lit(n))), n


def fetched(tests: DataFrame, block: int) -> Tests:
    return tests_of([(r["i"], r["t"]) for r in tests.where(F.col("b") == block).orderBy("i", "t").collect()])


RANGES = "array<struct<start:int,end:int>>"
MATCHES = "array<struct<start:int,length:int,item:string,item_start:int>>"
HITS = f"struct<n_words:bigint,ranges:{RANGES},items:array<string>,matches:{MATCHES}>"


def _found(column: pa.Array, tests: Tests) -> pa.Array:
    n_words, n_ranges, lo, hi, item_lists, match_lists = [], [0], [], [], [], []
    for a, b in A.slices(column):
        tok, first = tokens(column.slice(a, b - a))
        got = matches(tok, first, tests)
        n_words += np.diff(first).tolist()
        inside = A.covered(len(tok), got.place, got.place + got.need)
        row = np.searchsorted(first, got.place, "right") - 1
        seen: dict[int, set] = {}
        n_kinds = max(1, len(tests.distinct))
        for x in np.unique(row * n_kinds + got.kind).tolist():
            seen.setdefault(x // n_kinds, set()).update(tests.items_of(x % n_kinds))
        by_place: dict[int, tuple[int, int]] = {}
        for p, n, s in zip(got.place.tolist(), got.length.tolist(), got.suffix.tolist(), strict=True):
            by_place[p] = max(by_place.get(p, (0, 0)), (n, s))
        longest_of: dict[int, list] = {}
        for p, (n, s) in sorted(by_place.items()):
            r = int(np.searchsorted(first, p, "right")) - 1
            if p > first[r] and by_place.get(p - 1, (0, 0))[0] == n + 1:
                continue  # the rest of the match before
            item = int(tests.item[s])
            longest_of.setdefault(r, []).append({"start": p - int(first[r]), "length": n, "item": tests.items[item], "item_start": int(tests.start[s] - tests.first[item])})
        for r in range(b - a):
            if r in seen:
                s, e = A.runs(inside[first[r] : first[r + 1]])
                lo += s.tolist()
                hi += e.tolist()
            n_ranges.append(len(lo))
            item_lists.append(sorted(seen.get(r, ())))
            match_lists.append(longest_of.get(r, []))
    ranges = pa.ListArray.from_arrays(pa.array(n_ranges, pa.int32()), pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["start", "end"]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())]))
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), ranges, pa.array(item_lists, pa.list_(pa.string())), pa.array(match_lists, kind)], ["n_words", "ranges", "items", "matches"])


def hits(text: Column, tests: Tests) -> Column:
    """For each text: n_words, ranges of words that are hit (merged), the ids of the items, and the longest matches (where
    in the text and in the item, how many words; not those that lie at the end of the one before)."""

    @arrow_udf(HITS)
    def found(column: pa.Array) -> pa.Array:
        return _found(column, tests)

    return found(text)


def flagged(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_test_words: int = MOST_TEST_WORDS, out: str = "hits") -> DataFrame:
    """docs with a column `out`: n_words, n_hit, items (sorted as strings) and matches."""
    tests, n = blocks(benchmark, item_col, item_text, most_test_words)
    n_hit = lambda ranges: F.aggregate(ranges, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    if n == 1:
        found = docs.withColumn(out, hits(F.col(text_col), fetched(tests, 0)))
        return found.withColumn(out, F.struct(F.col(out)["n_words"].alias("n_words"), n_hit(F.col(out)["ranges"]).alias("n_hit"), F.col(out)["items"].alias("items"), F.col(out)["matches"].alias("matches")))
    tests = scratch.written(tests, "tests")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    per_block = []
    for k in range(n):  # one block in the driver and in the tasks at a time
        one = docs.select(digest.alias("d"), hits(F.col(text_col), fetched(tests, k)).alias("h")).where(F.size("h.ranges") > 0)
        per_block.append(scratch.written(one.select("d", "h.*"), "hits"))
    every = per_block[0]
    for x in per_block[1:]:
        every = every.unionByName(x)
    # equal texts have equal hits: a set of a few arrays for each text, one for each block
    words = F.flatten(F.transform(F.flatten(F.collect_set("ranges")), lambda x: F.sequence(x["start"], x["end"] - 1)))
    merged = every.groupBy("d").agg(F.size(F.array_distinct(words)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.flatten(F.collect_set("matches"))).alias("matches"))
    merged = scratch.written(merged.select(F.col("d").alias("__ks_d"), F.col("n_hit").alias("__ks_n"), F.col("items").alias("__ks_i"), F.col("matches").alias("__ks_m")), "merged")
    scratch.discard(tests, *per_block)
    none = tests_of([])
    joined = docs.withColumn("__ks_digest", digest).join(merged, F.col("__ks_digest") == F.col("__ks_d"), "left").withColumn("__ks_w", hits(F.col(text_col), none)["n_words"])
    both = F.struct(
        F.col("__ks_w").alias("n_words"), F.coalesce("__ks_n", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("__ks_i", F.array().cast("array<string>")).alias("items"), F.coalesce("__ks_m", F.array().cast(MATCHES)).alias("matches"),
    )
    return joined.withColumn(out, both).drop("__ks_digest", "__ks_d", "__ks_n", "__ks_i", "__ks_m", "__ks_w")
