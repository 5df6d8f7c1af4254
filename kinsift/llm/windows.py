"""Which windows of a fixed length occur elsewhere: what both substring operators share.

A corpus has as many windows as bytes (or words), too many to move. Each window is therefore
named by its anchor, the minimiser: of the k-grams inside it, the leftmost of those with the least hash.
Equal windows have equal anchors at equal places, so only what stands around an anchor
(one in about a hundred) is compared. Consecutive windows with the same anchor are a
*block*; its units are the *context* of the anchor.

* An anchor whose k-gram occurs once has no repeated window.
* Equal blocks are counted as one before anything is sorted (pre-aggregation): a passage that a third of
  all documents share is a few rows for each task.
* Distinct contexts of a k-gram are range-partitioned by their leading units from the anchor on, with splitters
  that Spark samples, and go in that order through a solver: `suffixes` sorts them, `parsing` factors them.

No k-gram is bound to one task. Splitters may cut through the contexts of a k-gram, and so does a task whose
piece grows beyond PIECE_BYTES. A k-gram that has been cut is found by comparing both sides of each boundary
(`compared`); of each side only those windows go on that have no witness on their own side, or are
one. They are partitioned anew by more leading units: windows with at most
lo..hi units before the anchor share the units from `lo` before to `window - hi` after it, so that halving lo..hi
gives longer and longer keys, down to the window itself. Each round doubles a row at most, and there
are as many as halvings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsift.plans import scratch

from . import arrays as A

PIECE_BYTES = 1 << 20  # contexts that are held in memory together
PIECE = 1 << 22  # units of a long text that are looked at together; places must fit in 24 bits


@dataclass(frozen=True)
class Unit:
    """What a window is made of. words: of words, else of bytes."""

    words: bool
    window: int
    gram: int

    @property
    def width(self) -> int:
        return 8 if self.words else 1

    def codes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of all rows and the offset of each row (one more at the end)."""
        data, offsets = A.flat(column)
        if not self.words:
            return data, offsets
        starts, ends, first = A.words(data, offsets)
        return A.word_hashes(data, starts, ends), first

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        return codes if self.words else A.BYTE_CODE[codes]


BYTES = Unit(words=False, window=200, gram=32)
WORDS = Unit(words=True, window=50, gram=8)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all ranges of w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(x)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    b = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - w + 1
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


def blocks_of(codes: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, minimiser, k-gram hash, block hash) of all blocks; places
    count from the start of the row. Long inputs are cut into overlapping pieces."""
    out: list[tuple] = []
    most = PIECE
    n = np.diff(offsets)
    a = 0
    while a < len(n):
        if n[a] > most:
            at = int(offsets[a])
            for s in range(0, int(n[a]) - unit.window + 1, most - unit.window):
                e = min(int(n[a]), s + most)
                got = _piece(codes[at + s : at + e], np.array([0, e - s]), unit)
                own = got[1] < most - unit.window  # windows that begin later belong to the next piece
                part = tuple(x[own] for x in got)
                limit = np.minimum(part[2], most - unit.window - part[1])
                if (limit < part[2]).any():  # a block that the cut divides: hashed anew below
                    part = _cut(codes[at + s : at + e], part, limit, unit)
                out.append((part[0] + a, part[1] + s, part[2], part[3] + s, part[4], part[5]))
            a += 1
            continue
        b = a + 1
        while b < len(n) and offsets[b + 1] - offsets[a] <= most:
            b += 1
        got = _piece(codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], unit)
        out.append((got[0] + a, *got[1:]))
        a = b
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block_hash(sums: np.ndarray, first: np.ndarray, count: np.ndarray, mini: np.ndarray, unit: Unit) -> np.ndarray:
    h = A.spans(sums, first, first + count + unit.window - 1)
    return A.mix(h + (mini - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))


def _cut(codes: np.ndarray, part: tuple, limit: np.ndarray, unit: Unit) -> tuple:
    sums = A.prefix(unit.hashed(codes))
    return (part[0], part[1], limit, part[3], part[4], _block_hash(sums, part[1], limit, part[3], unit))


def _piece(codes: np.ndarray, offsets: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    n, w, k = len(codes), unit.window, unit.gram
    z = np.zeros(0, np.int64)
    if n < w:
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    sums = A.prefix(unit.hashed(codes))
    at = np.arange(n - k + 1)
    grams = A.spans(sums, at, at + k)
    packed = (grams & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    mini = (sliding_min(packed, w - k + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(n - w + 1)
    row = np.searchsorted(offsets, starts, "right") - 1
    whole = starts + w <= offsets[row + 1]
    starts, row, mini = starts[whole], row[whole], mini[whole]
    if not len(starts):
        return z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    new = np.concatenate(([True], (mini[1:] != mini[:-1]) | (row[1:] != row[:-1])))
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate((head, [len(starts)])))
    first, mini, row = starts[head], mini[head], row[head]
    begin = offsets[row]
    return row, first - begin, count, mini - begin, grams[mini], _block_hash(sums, first, count, mini, unit)


def row_hash(text_col: str):
    """Tells rows that share an id (or have none) apart."""
    return F.xxhash64(F.col(text_col))


def occurrences(docs: DataFrame, unit: Unit, id_col: str, text_col: str) -> DataFrame:
    """All blocks: gram, block, doc, sig (a hash of the text, so that rows that share an id
    are told apart), first, n."""
    src = docs.select(F.col(id_col).alias("doc"), row_hash(text_col).alias("sig"), F.col(text_col).alias("text"))
    kind = src.schema["doc"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in A.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                row, first, count, _, gram, block = blocks_of(*unit.codes(part.column("text")), unit)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(block.view(np.int64)), part.column("doc").take(take), part.column("sig").take(take), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["gram", "block", "doc", "sig", "first", "n"])

    return src.mapInArrow(emit, f"gram bigint, block bigint, doc {kind}, sig bigint, first int, n int")


def anchors(codes: np.ndarray, starts: np.ndarray, unit: Unit) -> np.ndarray:
    """Where the anchor stands in each window that begins at `starts`."""
    if not len(starts):
        return starts
    at = np.arange(len(codes) - unit.gram + 1)
    high = A.spans(A.prefix(unit.hashed(codes)), at, at + unit.gram) >> np.uint64(24)
    return high[starts[:, None] + np.arange(unit.window - unit.gram + 1)].argmin(axis=1)


def contexts(reps: DataFrame, docs: DataFrame, unit: Unit, id_col: str, text_col: str) -> DataFrame:
    """The units of each distinct block, read from one occurrence: gram, block, n, doc, need, mini (where
    the anchor stands) and ctx (all units of the block, big-endian)."""
    per_doc = reps.groupBy("doc", "sig").agg(F.collect_list(F.struct("gram", "block", "first", "n", "need")).alias("want"))
    src = docs.select(F.col(id_col).alias("d2"), row_hash(text_col).alias("s2"), F.col(text_col).alias("text"))
    joined = src.join(per_doc, (F.col("d2").eqNullSafe(F.col("doc"))) & (F.col("s2") == F.col("sig"))).select("doc", "text", "want")
    kind = joined.schema["doc"].dataType.simpleString()
    names = ["gram", "block", "n", "doc", "need", "mini", "ctx"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in A.slices(b.column("text")):
                part = b.slice(lo, hi - lo)
                codes, offsets = unit.codes(part.column("text"))
                want = part.column("want")
                flat = want.flatten()
                row = np.repeat(np.arange(hi - lo), np.asarray(want.value_lengths()))
                s = offsets[row] + flat.field("first").to_numpy()
                e = s + flat.field("n").to_numpy() + unit.window - 1
                data = codes.tobytes() if not unit.words else codes.astype(">u8").tobytes()
                u = unit.width
                mini = anchors(codes, s, unit)
                ctx = [data[x * u : y * u] for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                docs_of = part.column("doc").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([flat.field("gram"), flat.field("block"), flat.field("n"), docs_of, flat.field("need"), pa.array(mini, pa.int32()), pa.array(ctx, pa.binary())], names)

    return joined.mapInArrow(emit, f"gram bigint, block bigint, n int, doc {kind}, need boolean, mini int, ctx binary")


@dataclass
class Piece:
    """Contexts in order, for a solver. open: which windows count (rows x windows)."""

    group: np.ndarray  # equal for the contexts of a group; groups stand together
    doc: list
    n: np.ndarray
    mini: np.ndarray
    codes: list[np.ndarray]
    lo: np.ndarray
    hi: np.ndarray
    open: np.ndarray
    need: np.ndarray


#: (hit, on): which windows of a piece have a witness in it; which have to go on to other pieces.
Solver = Callable[[Piece, Unit], tuple[np.ndarray, np.ndarray]]


def _piece_of(rows: list[tuple], unit: Unit) -> Piece:
    group = np.cumsum([k > 0 and (r["lo"], r["key"]) != (rows[k - 1]["lo"], rows[k - 1]["key"]) for k, r in enumerate(rows)])
    n, mini, lo, hi = (np.array([r[c] for r in rows], np.int64) for c in ("n", "mini", "lo", "hi"))
    w = np.arange(n.max())
    a = mini[:, None] - w  # units before the anchor
    is_open = (w < n[:, None]) & (a >= lo[:, None]) & (a <= hi[:, None])
    for k, r in enumerate(rows):
        if r["open"] is not None:
            is_open[k, : n[k]] &= np.unpackbits(np.frombuffer(r["open"], np.uint8), count=n[k]).astype(bool)
    codes = [np.frombuffer(r["ctx"], ">u8" if unit.words else np.uint8).astype(np.uint64 if unit.words else np.uint8, copy=False) for r in rows]
    return Piece(group, [r["doc"] for r in rows], n, mini, codes, lo, hi, is_open, np.array([r["need"] for r in rows], bool))


def _runs(mask: np.ndarray) -> list[dict]:
    s, e = A.runs(mask)
    return [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]


RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: What goes on to the next round.
ON = ("gram", "block", "n", "doc", "need", "mini", "ctx", "lo", "hi", "open")


def _round(rows: DataFrame, unit: Unit, solve: Solver, parts: int, by_doc: bool) -> DataFrame:
    """Partitions and solves once. Rows with `runs` are results; rows with `kid` go on where their
    group, `kid`, has been cut."""
    u, w = unit.width, unit.window
    lead = F.substring("ctx", (F.col("mini") - F.col("lo")) * u + 1, (F.col("lo") + w - F.col("hi")) * u)
    keyed = rows.withColumn("key", lead).withColumn("kid", F.xxhash64("lo", "key"))
    more = F.substring("ctx", (F.col("mini") + w - F.col("hi")) * u + 1, F.lit(4 * u))
    order = ["lo", "key", *(["doc"] if by_doc else [more]), "block"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    doc = rows.schema["doc"].dataType.simpleString()
    schema = f"gram bigint, block bigint, runs array<struct<start:int,end:int>>, part int, kid bigint, cut boolean, n int, doc {doc}, need boolean, mini int, ctx binary, lo int, hi int, open binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[dict] = []
        cuts: set = set()
        size, first, kind = 0, None, None

        def close(at_end: bool) -> pa.RecordBatch:
            piece = _piece_of(held, unit)
            hit, on = solve(piece, unit)
            last = held[-1]["kid"] if at_end else None
            out: list[dict] = []
            for k in np.flatnonzero(hit.any(axis=1) & piece.need).tolist():
                out.append({"gram": held[k]["gram"], "block": held[k]["block"], "runs": _runs(hit[k] & piece.open[k])})
            for k, r in enumerate(held):
                if not (r["kid"] == first or r["kid"] == last or r["kid"] in cuts):
                    continue
                mask, mid = on[k] & piece.open[k], (r["lo"] + r["hi"]) // 2
                a = r["mini"] - np.arange(len(mask))
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    if lo <= hi and (mask & (a >= lo) & (a <= hi)).any():
                        out.append({c: r[c] for c in ON} | {"part": part, "kid": r["kid"], "cut": r["kid"] in cuts, "lo": lo, "hi": hi, "open": np.packbits(mask[: r["n"]]).tobytes()})
            arrays = [pa.array([r.get(name) for r in out], t) for name, t in kind]
            return pa.RecordBatch.from_arrays(arrays, [name for name, _ in kind])

        for b in batches:
            if kind is None:
                fixed = {"gram": pa.int64(), "block": pa.int64(), "runs": RUNS, "part": pa.int32(), "kid": pa.int64(), "cut": pa.bool_(), "n": pa.int32(), "doc": b.schema.field("doc").type, "need": pa.bool_(), "mini": pa.int32(), "ctx": pa.binary(), "lo": pa.int32(), "hi": pa.int32(), "open": pa.binary()}
                kind = list(fixed.items())
            for r in b.to_pylist():
                if not held and first is None:
                    first = r["kid"]
                if held and size > PIECE_BYTES:
                    if held[-1]["kid"] == r["kid"]:
                        cuts.add(r["kid"])
                    yield close(False)
                    held, size = [], 0
                if held and held[-1]["gram"] == r["gram"] and held[-1]["block"] == r["block"] and held[-1]["lo"] == r["lo"]:
                    continue  # read from a repeated row
                held.append(r)
                size += len(r["ctx"])
        if held:
            yield close(True)

    return ranged.mapInArrow(emit, schema)


def compared(rows: DataFrame, unit: Unit, solve: Solver, by_doc: bool) -> tuple[DataFrame, list[DataFrame]]:
    """gram, block, runs (of windows of the block, counted from its first) that have a witness; and
    the tables that it is read from."""
    spark = rows.sparkSession
    most = parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(unit.window - unit.gram), "open": F.lit(None).cast("binary")})
    found, made = [], []
    while True:
        out = scratch.written(_round(rows, unit, solve, parts, by_doc), "compared")
        found.append(out.where("runs IS NOT NULL").select("gram", "block", "runs"))
        on = out.where("kid IS NOT NULL")
        # both sides of every boundary: a group that two partitions end with or begin with, or that a task has cut
        cut = on.groupBy("kid").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.max("cut").alias("c")).where("c OR p0 <> p1").select("kid")
        rows = scratch.written(on.join(cut, "kid", "left_semi").select(*ON), "cut")
        made += [out, rows]
        size = rows.agg(F.coalesce(F.sum(F.length("ctx")), F.lit(0)).alias("s")).first()["s"]
        if not size:
            break
        one = rows.where("lo = hi")  # the key is the window itself: nothing is left to sort
        window = one.select("gram", "block", "doc", "need", (F.col("mini") - F.col("lo")).alias("at"), F.substring("ctx", (F.col("mini") - F.col("lo")) * unit.width + 1, F.lit(unit.window * unit.width)).alias("window"))
        seen = scratch.written(window.groupBy("window").agg(F.count("*").alias("times"), F.min("doc").alias("least")), "windows")
        made.append(seen)
        same = window.where("need").join(seen, "window").where("doc > least" if by_doc else "times > 1")
        found.append(same.select("gram", "block", F.array(F.struct(F.col("at").alias("start"), (F.col("at") + 1).alias("end"))).alias("runs")))
        rows = rows.where("lo < hi")
        parts = max(1, min(most, -(-size // PIECE_BYTES)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("gram", "block").agg(F.flatten(F.collect_set("runs")).alias("runs")), made


def repeated(docs: DataFrame, unit: Unit, id_col: str, text_col: str, solve: Solver, any_other: bool) -> DataFrame:
    """doc, sig, spans: for each document the ranges of units (not merged) that repeated windows cover.

    any_other: a window is repeated if it starts anywhere else; else if it starts in a row with
    a smaller id (rows without an id are then left out)."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    if not any_other:
        docs = docs.where(F.col(id_col).isNotNull())
    occ = every = scratch.written(occurrences(docs, unit, id_col, text_col), "occurrences")
    grams = occ.groupBy("gram").agg(F.count("*").alias("times"), F.min("block").alias("b0"), F.max("block").alias("b1"), F.min("doc").alias("d0"))
    # written, so that adaptive execution can split the join below where a k-gram is hot
    grams = scratch.written(grams.where("times > 1").select(F.col("gram").alias("g2"), (F.col("b0") != F.col("b1")).alias("mixed"), "d0"), "grams")
    occ = occ.join(grams, F.col("gram") == F.col("g2")).drop("g2")
    if not any_other:
        # where a k-gram is first, no window of it has been before; but its block may be a witness
        occ = occ.where(F.col("mixed") | (F.col("doc") > F.col("d0")))
    occ = scratch.written(occ.select("gram", "block", "doc", "sig", "first", "n", "mixed"), "blocks")
    scratch.discard(every, grams)
    sure = occ.where("NOT mixed").select("doc", "sig", F.col("first").alias("start"), (F.col("first") + F.col("n") + F.lit(unit.window - 1)).alias("end"))
    blocks = occ.where("mixed").groupBy("gram", "block").agg(F.count("*").alias("times"), F.min("doc").alias("d0"), F.min(F.struct("doc", "sig", "first", "n")).alias("r"))
    blocks = scratch.written(blocks.select("gram", "block", "times", "d0", "r.*"), "distinct")
    groups = blocks.groupBy("gram").agg(F.min("d0").alias("gd0")).select(F.col("gram").alias("g2"), "gd0")
    need = (F.col("times") == 1) if any_other else (F.col("d0") > F.col("gd0"))
    reps = blocks.join(groups, F.col("gram") == F.col("g2")).select("gram", "block", "doc", "sig", "first", "n", need.alias("need"))
    read = scratch.written(contexts(reps, docs, unit, id_col, text_col), "contexts")
    runs, made = compared(read, unit, solve, by_doc=not any_other)
    # what is known of each distinct block: all its windows (for occurrences after its first) and runs
    known = blocks.select(F.col("gram").alias("g2"), F.col("block").alias("k2"), F.col("times").alias("t2"), F.col("d0").alias("first_doc")).join(runs.select(F.col("gram").alias("g3"), F.col("block").alias("k3"), "runs"), (F.col("g2") == F.col("g3")) & (F.col("k2") == F.col("k3")), "left").drop("g3", "k3")
    known = scratch.written(known.where("t2 > 1 OR runs IS NOT NULL"), "known")
    scratch.discard(blocks, read, *made)
    whole = (F.col("t2") > 1) if any_other else (F.col("doc") > F.col("first_doc"))
    part = occ.where("mixed").join(known, (F.col("gram") == F.col("g2")) & (F.col("block") == F.col("k2")))
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end")))
    part = part.select("doc", "sig", "first", F.explode(F.when(whole, all_of).otherwise(F.col("runs"))).alias("x"))
    part = part.select("doc", "sig", (F.col("first") + F.col("x.start")).alias("start"), (F.col("first") + F.col("x.end") + F.lit(unit.window - 1)).alias("end"))
    return sure.unionByName(part).groupBy("doc", "sig").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


SPANS = "__ks_spans"


def with_spans(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs (all rows and columns) with the column SPANS, null where there are none."""
    found = found.select(F.col("doc").alias("__ks_doc"), F.col("sig").alias("__ks_sig"), F.col("spans").alias(SPANS))
    own = docs.withColumn("__ks_own", row_hash(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__ks_doc")) & (F.col("__ks_own") == F.col("__ks_sig"))
    return own.join(found, same, "left").drop("__ks_doc", "__ks_sig", "__ks_own")
