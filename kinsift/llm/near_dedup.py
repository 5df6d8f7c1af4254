"""Near-duplicate detection with BagMinHash signatures.

A text is a multiset of shingles of five words. Each shingle of weight c owns Poisson processes
over time and over the discretised weights 0..c: one for each dyadic range of weights (0-1,
1-2, 2-4, ...). A point descends the halves of its range to one unit of weight and counts only
below c, so that two texts see the same points for the weight they share. A register
keeps the time of the earliest point dealt to it; two texts agree in a register with
probability equal to their weighted Jaccard similarity. Points are made in order of time, and a
process stops when it is later than all registers, which is soon.

Bands of registers give candidates. Equal texts (by a 128-bit digest of their words) count once. In each bucket all texts are
first held against one leader (the one with most copies) only; verified links form components.
Where a bucket still spans several components, its texts outside the leader's component are held against each other and
against those of the component that may be near enough, in blocks (`rest_links`), from which only links that join
components come out. One minus the similarity is a metric, so that a text at distance d from the leader can have no
link to one nearer to it than d - (1 - threshold): a large group of near copies, most of which are close to its leader,
costs a row per text. No pair of a bucket is left undecided. Candidates are verified by multiset overlap of the shingles of whole texts.

Two texts of similarity s share one of `bands` buckets with probability 1-(1-s^rows)^bands: for 25
bands of 5 rows 0.99995 at 0.8 and more above.

Texts are compared by words between white space, A-Z lower-cased. A text of one to four words is
one shingle. Null texts and texts without a word, and rows with a null id, are classes of
their own. Repeated rows are in one class; ties go to the least id. Other columns stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.operators.components import components
from kinsift.plans import scratch

from . import arrays as A

SHINGLE, BANDS, ROWS = 5, 25, 5
#: Bytes of text looked at at once; temporary arrays take some sixty times as many.
SLICE = 512 << 10
_GOLD = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each row, sorted by row and hash; and the number
    of words of each row."""
    data, offsets = A.flat(column)
    data = LOWER[data]
    starts, ends, first = A.words(data, offsets)
    words = A.word_hashes(data, starts, ends)
    n = np.diff(first)
    sums = A.prefix(words)
    take = np.maximum(n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), take)
    at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + first[:-1][row]
    h = A.spans(sums, at, np.minimum(at + k, first[1:][row]))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[new], h[new], np.diff(np.concatenate((new, [len(row)]))), n


def digests(column: pa.Array) -> list[bytes]:
    """A 128-bit digest of the words of each row, joined by one space."""
    data, offsets = A.flat(column)
    inside = A.SPACED[data]
    gap = ~inside
    gap[1:] &= inside[:-1]  # the first blank behind a word stands for all
    gap[offsets[:-1][offsets[:-1] < len(data)]] &= inside[offsets[:-1][offsets[:-1] < len(data)]]
    keep = inside | gap
    at = np.concatenate(([0], np.cumsum(keep)))[offsets].tolist()
    left = np.where(inside, LOWER[data], 32).astype(np.uint8)[keep].tobytes()
    return [hashlib.blake2b(left[a:b].rstrip(b" "), digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]


def node(id_col: str, text_col: str):
    """A row: its id and a hash of its text, so that rows that share an id are told apart."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")).alias("node")


def signatures(row: np.ndarray, h: np.ndarray, count: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """BagMinHash registers (times of points) of each row; infinite where a row is empty."""
    reg = np.full((n_rows, m), np.inf)
    flat = reg.ravel()
    # one process for each dyadic range of weights that begins below the count
    seeds, rows, lows, widths, tops = [], [], [], [], []
    level, low, width = 0, 0, 1
    live = np.arange(len(h))
    while len(live):
        seeds.append(A.mix(h[live] + np.uint64((level + 1) * int(_GOLD) % 2**64)))
        rows.append(row[live])
        lows.append(np.full(len(live), low))
        widths.append(np.full(len(live), width))
        tops.append(count[live])
        low, width = (1, 1) if level == 0 else (low * 2, width * 2)
        level += 1
        live = live[count[live] > low]
    if not seeds:
        return reg
    seed, r, lo, wd, top = (np.concatenate(x) for x in (seeds, rows, lows, widths, tops))
    t = np.zeros(len(seed))
    while len(seed):
        seed = A.mix(seed + _GOLD)
        t = t - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / wd
        keep = t < reg.max(axis=1)[r]
        seed, r, lo, wd, top, t = seed[keep], r[keep], lo[keep], wd[keep], top[keep], t[keep]
        draw = A.mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        unit = lo + ((draw >> np.uint64(32)).astype(np.int64) & (wd - 1))  # the halves it descends to
        below = unit < top
        slot = r[below] * m + ((draw[below] & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, slot, t[below])
    return reg


def overlap(a: tuple, b: tuple, n_rows: int) -> np.ndarray:
    """Weighted Jaccard similarity of the multisets of each row of a and b."""
    row = np.concatenate((a[0], b[0]))
    h = np.concatenate((a[1], b[1]))
    c = np.concatenate((a[2], b[2])).astype(np.float64)
    order = np.lexsort((h, row))
    row, h, c = row[order], h[order], c[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(row[same], weights=np.minimum(c[same], c[same + 1]), minlength=n_rows)
    total = np.bincount(row, weights=c, minlength=n_rows)
    return both / np.maximum(total - both, 1)


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """node, k (a digest of all words; null where nothing can be compared) and keys (of bands)."""
    m = bands * rows
    src = docs.select(node(id_col, text_col), F.col(text_col).alias("text"))
    kind = src.schema["node"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in A.slices(b.column("text"), SLICE):
                part = b.slice(lo, hi - lo)
                row, h, count, n = shingles(part.column("text"))
                size = hi - lo
                reg = signatures(row, h, count, size, m)
                bits = A.mix(reg.view(np.uint64)).reshape(size, bands, rows)
                key = np.zeros((size, bands), np.uint64)
                for j in range(rows):
                    key = A.mix(key * _GOLD + bits[:, :, j])
                key = A.mix(key + np.arange(bands, dtype=np.uint64) * _GOLD)
                void = (n == 0) | np.asarray(part.column("node").field("id").is_null())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * bands, pa.int32()), pa.array(key.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(digests(part.column("text")), pa.binary(), mask=void), keys], ["node", "k", "keys"])

    return src.mapInArrow(emit, f"node {kind}, k binary, keys array<bigint>")


def scored(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with the overlap s of their texts (node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    kind = both.schema["a"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.add(pa.compute.binary_length(batch.column("ta")), pa.compute.binary_length(batch.column("tb"))).to_numpy(zero_copy_only=False)
            done = 0
            while done < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[done:]), 2 * SLICE, "right")))
                part = batch.slice(done, n)
                s = overlap(shingles(part.column("ta")), shingles(part.column("tb")), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s)], ["a", "b", "s"])
                done += n

    return both.mapInArrow(emit, f"a {kind}, b {kind}, s double")


def linked(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of row numbers) between rows of the rest (`rest` is true) and all rows of a block
    that join different components (`c`): a spanning forest of the exact similarities.

    Shingles become columns, the k-th copy of one a column of its own; those of a single row say nothing
    and are left out; a matrix product over slices of columns counts what rows share."""
    row, h, count, _ = shingles(group.column("text").combine_chunks())
    n = group.num_rows
    size = np.bincount(row, weights=count, minlength=n)
    rep = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
    keys = A.mix(h[rep] + nth.astype(np.uint64) * _GOLD)
    _, col, times = np.unique(keys, return_inverse=True, return_counts=True)
    use = times[col] > 1
    who = row[rep][use]
    _, col = np.unique(col[use], return_inverse=True)
    rest = np.asarray(group.column("rest").combine_chunks().to_numpy(zero_copy_only=False), bool)
    x, y = np.flatnonzero(rest), np.arange(n)
    shared = np.zeros((len(x), n), np.float32)
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    width = max(256, (8 << 20) // max(1, n))
    for lo in range(0, int(col.max(initial=-1)) + 1, width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((n, width), np.float32)
        m[who[i:j], col[i:j] - lo] = 1
        shared += m[x] @ m.T
    alike = shared >= (threshold - 1e-12) * (size[x][:, None] + size[None, :] - shared)
    c = group.column("c").combine_chunks()
    label = np.unique(np.array([f"{v['id']}/{v['th']}" for v in c.to_pylist()]), return_inverse=True)[1]
    alike &= label[x][:, None] != label[y][None, :]
    parent = np.arange(label.max(initial=0) + 1)

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for p, q in zip(*np.nonzero(alike), strict=True):
        u, v = root(label[x[p]]), root(label[q])
        if u != v:
            parent[u] = v
            out.append((x[p], q))
    return np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)


BLOCK = 512


def rest_links(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: links of texts outside their leader's component.

    rest: leader, main (its component), rep, c, d (distance from the leader). The buckets of one leader are one group: its
    texts outside the main component, and those inside that are not too near to the leader for a link to them.
    Both are dealt out in blocks, and those outside are held against every block: a stated set against all, in
    blocks of a fixed number of rows, so that no task holds a group."""
    outside = F.col("c") != F.col("main")
    least = rest.where(outside).groupBy("leader").agg((F.min("d") - (1 - threshold) - 1e-9).alias("near")).select(F.col("leader").alias("l"), "near")
    r = scratch.written(rest.join(least, F.col("leader") == F.col("l")).where(outside | (F.col("d") >= F.col("near"))).select("leader", "main", "rep", "c"), "near")
    sizes = r.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ny"), F.ceil(F.count_if(outside) / BLOCK).cast("int").alias("nx"))
    r = r.join(scratch.written(sizes.select(F.col("leader").alias("w"), "ny", "nx"), "sizes"), F.col("leader") == F.col("w")).drop("w")
    r = r.join(texts, F.col("rep") == F.col("node")).drop("node")
    h = F.xxhash64("rep")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    as_x = r.where(outside).select("leader", F.pmod(h, F.col("nx")).cast("int").alias("bx"), F.explode(span(F.col("ny"))).alias("by"), "rep", "c", F.lit(True).alias("rest"), "text")
    as_y = r.select("leader", F.explode(span(F.col("nx"))).alias("bx"), F.pmod(h, F.col("ny")).cast("int").alias("by"), "rep", "c", F.lit(False).alias("rest"), "text")
    dealt = as_x.unionByName(as_y).withColumn("g", F.concat_ws(":", F.col("leader.id").cast("string"), F.col("leader.th").cast("string"), "bx", "by")).select("g", "rep", "c", "rest", "text")
    own = dealt.repartition("g").sortWithinPartitions("g")
    kind = own.schema["rep"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x, y = linked(t, threshold)
            rep = t.column("rep").combine_chunks()
            return pa.RecordBatch.from_arrays([rep.take(pa.array(x)), rep.take(pa.array(y))], ["a", "b"])

        for b in batches:
            g = b.column("g").to_pylist()
            at = 0
            for k in range(1, len(g) + 1):
                if k == len(g) or g[k] != g[at]:
                    if now is not None and g[at] != now and held:
                        yield close()
                        held = []
                    now = g[at]
                    held.append(b.slice(at, k - at))
                    at = k
        if held:
            yield close()

    return own.mapInArrow(emit, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: its id, class_id (the least id of its class), and kept (its id is that one)."""
    out = classes(docs, id_col, text_col, threshold, bands, rows)
    return out.select(F.col("node.id").alias(id_col), F.coalesce("c.id", "node.id").alias("class_id"), F.coalesce(F.col("c") == F.col("node"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each class (that of the least id; of repeated rows one)."""
    out = classes(docs, id_col, text_col, threshold, bands, rows)
    gone = out.where("c IS NOT NULL AND c <> node").select(F.col("node.id").alias("__ks_id"), F.col("node.th").alias("__ks_hash")).distinct()
    own = docs.withColumn("__ks_own", F.xxhash64(F.col(text_col)))
    left = own.join(gone, F.col(id_col).eqNullSafe(F.col("__ks_id")) & (F.col("__ks_own") == F.col("__ks_hash")), "left_anti")
    twice = out.where("c IS NOT NULL AND c = node").groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(F.col("node.id").alias("__ks_id"), F.col("node.th").alias("__ks_hash"))
    twice = scratch.written(twice, "repeats")
    if twice.limit(1).count():  # rows that repeat an id and a text: one stays
        again = left.join(twice, F.col(id_col).eqNullSafe(F.col("__ks_id")) & (F.col("__ks_own") == F.col("__ks_hash")), "left_semi").dropDuplicates([id_col, "__ks_own"])
        left = left.join(twice, F.col(id_col).eqNullSafe(F.col("__ks_id")) & (F.col("__ks_own") == F.col("__ks_hash")), "left_anti").unionByName(again)
    return left.drop("__ks_own")


def texts_of(docs: DataFrame, sig: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, text: one row of each node. Only where rows are repeated are texts grouped for it."""
    texts = docs.select(node(id_col, text_col), F.col(text_col).alias("text"))
    if sig.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))  # aggregated before the shuffle
    return texts


def classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, bands: int, rows: int) -> DataFrame:
    """node and c (the least node of its class, null where nothing can be compared) of each row."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    sig = scratch.written(signed(docs, id_col, text_col, bands, rows), "signatures")
    known = sig.where("k IS NOT NULL")
    reps = scratch.written(known.groupBy("k").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "texts")
    each = reps.select("rep", "copies", F.explode("keys").alias("key"))
    buckets = each.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct((-F.col("copies")).alias("few"), "rep")).alias("first")).where("c > 1")
    placed = scratch.written(each.join(buckets.select(F.col("key").alias("k2"), F.col("first.rep").alias("leader")), F.col("key") == F.col("k2")).select("key", "rep", "leader"), "buckets")
    # texts that are in a bucket with others, read and dealt out once
    used = placed.select(F.col("rep").alias("u")).distinct()
    texts = scratch.written(texts_of(docs, sig, id_col, text_col).join(used, F.col("node") == F.col("u"), "left_semi"), "compared")
    pairs = placed.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    first = scratch.written(scored(pairs, texts), "scored")
    class_of = components(first.where(F.col("s") >= threshold - 1e-12))
    # buckets that span several components
    at = placed.join(class_of.select(F.col("node").alias("w"), "least"), F.col("rep") == F.col("w"), "left").select("key", "rep", "leader", F.coalesce("least", "rep").alias("c"))
    at = scratch.written(at, "placed")
    mixed = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.when(F.col("rep") == F.col("leader"), F.col("c"))).alias("main")).where("lo <> hi").select(F.col("key").alias("k2"), "main")
    rest = at.join(mixed, F.col("key") == F.col("k2")).select("leader", "main", "rep", "c").distinct()
    far = first.select("a", "b", (1 - F.col("s")).alias("d"))
    rest = rest.join(far, (F.col("rep") == F.col("a")) & (F.col("leader") == F.col("b")), "left").select("leader", "main", "rep", "c", F.coalesce("d", F.lit(0.0)).alias("d"))
    rest = scratch.written(rest, "rest")
    if rest.limit(1).count():
        added = scratch.written(rest_links(rest, texts, threshold), "more")
        if added.limit(1).count():
            # known components are stars already
            stars = class_of.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
            class_of = components(stars.unionByName(added))
    scratch.discard(texts, placed, at, rest, first)
    of = reps.select(F.col("k").alias("j"), "rep").join(class_of, F.col("rep") == F.col("node"), "left").select("j", F.coalesce("least", "rep").alias("c"))
    return sig.select("node", "k").join(of, F.col("k") == F.col("j"), "left").select("node", "c")
