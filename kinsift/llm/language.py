"""Language identification as inference of a mixture.

Each word's likelihood under each language comes from letter n-grams (Katz-like interpolation of
orders 1 to 3 with word boundaries). A document is a mixture of languages; expectation
maximisation estimates their proportions from its words, languages are taken out one by one
while the penalised likelihood (BIC) gains by it, and the language with the largest share is
predicted. Its share is the score.

The models are tables of n-gram hashes with a log probability per language, learned from a sample of about
`fit_rows` texts per language, chosen by a hash of the id; all n-grams of the sample that occur `least` times
or more in a language count, so that a model's size is bounded by the sample's, language by language.

Null texts and texts without a letter are `und` with score 0; repeated rows are judged each by
itself; without anything learned every text is `und`. Rows without an id, text or language are not learned from; a row
without an id is held out. Ties go to the language that sorts first. Empty tables give empty results; long texts
are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import arrays as A

FIT_ROWS = 2_000  # texts per language
LEAST = 3  # times that an n-gram of two or more letters occurs in a language
ORDERS = (1, 2, 3)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all texts as code points, with one 0 between words (and texts), the
    starts of words, and for each row the index of its first word (one more at the end)."""
    codes, offsets = [], [0]
    for t in column:
        s = t.as_py()
        codes.append(np.frombuffer((s or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32))
        offsets.append(offsets[-1] + len(codes[-1]))
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    return flat, np.array(offsets, np.int64), _is_letter(flat)


_LETTER = np.zeros(0x110000, bool)
_LETTER_READY = False


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _LETTER_READY
    if not _LETTER_READY:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
        _LETTER_READY = True
    return _LETTER[codes]


@dataclass
class Words:
    """Distinct words of a slice (as ranges of `codes`) and the words of each row."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray  # for each occurrence: which distinct word
    first: np.ndarray  # for each row: its first occurrence


def words_of(column: pa.Array) -> Words:
    codes, offsets, inside = letters(column)
    n = len(codes)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(codes, z, z, z, np.zeros(len(offsets), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    h = A.spans(A.prefix(A.mix(codes)), starts, ends)
    _, index, of = np.unique(h, return_index=True, return_inverse=True)
    return Words(codes, starts[index], ends[index], of, np.searchsorted(starts, offsets))


def grams(w: Words) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For each letter of the distinct words: its word, and for each order the hash of the n-gram
    that ends with it (a word begins with a boundary; shorter ones stand for it there)."""
    lengths = w.ends - w.starts
    word = np.repeat(np.arange(len(lengths)), lengths)
    if not len(word):
        return word, {k: np.zeros(0, np.uint64) for k in ORDERS}
    into = np.arange(len(word)) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    c = w.codes[w.starts[word] + into].astype(np.uint64)
    out = {}
    h = c
    out[1] = A.mix(h + np.uint64(1 << 40))
    for k in ORDERS[1:]:
        prev = np.zeros(len(c), np.uint64)
        prev[k - 1 :] = c[: len(c) - k + 1] if k > 1 else c
        prev[into < k - 1] = 1  # the boundary
        h = A.mix(h * np.uint64(0x9E3779B97F4A7C15) + prev)
        out[k] = A.mix(h + np.uint64(k << 40))
    return word, out


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of n-grams
    logp: np.ndarray  # for each: log2 odds against the mean language, per language


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, least: int = LEAST) -> Model:
    """Learns from rows with a text and a language; of a language with more than fit_rows those whose ids have hashes in the
    part of all hashes that holds about as many (a bound of what is learned from). The number of languages is
    taken to be small (hundreds)."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("i IS NOT NULL AND t IS NOT NULL AND l IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 1), np.float32))
    share = rows.sparkSession.createDataFrame([(x, min(1.0, fit_rows / sizes[x])) for x in langs], "l2 string, share double")
    place = F.pmod(F.xxhash64("i", F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(F.broadcast(share), F.col("l") == F.col("l2")).where(place < F.col("share"))

    def count(batches):
        for b in batches:
            for lang in sorted(set(b.column("l").to_pylist())):
                mine = b.filter(pa.compute.equal(b.column("l"), lang))
                w = words_of(mine.column("t"))
                word, g = grams(w)
                times = np.bincount(w.of, minlength=len(w.starts))[word] if len(word) else np.zeros(0, np.int64)
                for k in ORDERS:
                    keys, inverse = np.unique(g[k], return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([k] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(np.bincount(inverse, weights=times, minlength=len(keys)).astype(np.int64))], ["l", "k", "g", "n"])

    counted = sample.select("l", "t").mapInArrow(count, "l string, k int, g bigint, n bigint").groupBy("l", "k", "g").agg(F.sum("n").alias("n"))
    top = counted.where((F.col("n") >= least) | (F.col("k") == 1)).toPandas()
    where = {x: j for j, x in enumerate(langs)}
    keys = np.unique(top["g"].to_numpy(np.int64).view(np.uint64))
    counts = np.zeros((len(keys), max(1, len(langs))))
    order = np.zeros(len(keys), int)
    at = np.searchsorted(keys, top["g"].to_numpy(np.int64).view(np.uint64))
    np.add.at(counts, (at, np.array([where[x] for x in top["l"]], int)), top["n"].to_numpy(float))
    order[at] = top["k"].to_numpy(int)
    logp = np.zeros_like(counts)
    for k in ORDERS:
        m = order == k
        c = counts[m] + 0.5
        p = c / np.maximum(counts[m].sum(axis=0) + 0.5 * m.sum(), 1)
        logp[m] = np.log2(p) - np.log2(p).mean(axis=1, keepdims=True)
    return Model(langs, keys, logp.astype(np.float32))


def word_likelihoods(w: Words, model: Model) -> np.ndarray:
    """For each distinct word its log2 likelihood in each language, against the mean."""
    word, g = grams(w)
    out = np.zeros((len(w.starts), len(model.langs)))
    if not len(word) or not len(model.keys):
        return out
    total, weight = np.zeros((len(word), len(model.langs)), np.float32), np.zeros((len(word), 1), np.float32)
    for k in ORDERS:
        at = np.minimum(np.searchsorted(model.keys, g[k]), len(model.keys) - 1)
        known = model.keys[at] == g[k]
        total[known] += k * model.logp[at[known]]
        weight[known] += k
    total /= np.maximum(weight, 1)
    starts = np.concatenate(([0], np.cumsum(w.ends - w.starts)[:-1]))
    return np.add.reduceat(total, starts, axis=0)


def mixtures(logl: np.ndarray, row: np.ndarray, times: np.ndarray, n_rows: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of languages in each row and their penalised likelihood, by expectation
    maximisation with removal of languages that don't pay for themselves. logl, row, times: of each distinct
    word of a row its likelihoods, its row and how often it occurs there."""
    n_lang = logl.shape[1]
    like = np.exp2(np.clip(logl - logl.max(axis=1, keepdims=True), -40, 0)) + 1e-9
    size = np.maximum(np.bincount(row, weights=times, minlength=n_rows), 1)[:, None]
    pi = np.full((n_rows, n_lang), 1 / n_lang)

    def step(pi: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = pi[r] * x
        z *= (times / z.sum(axis=1))[:, None]
        return np.column_stack([np.bincount(r, weights=z[:, j], minlength=n_rows) for j in range(n_lang)]) / size

    def fit_of(pi: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=times * np.log((pi[row] * like).sum(axis=1) + 1e-300), minlength=n_rows)

    for _ in range(rounds):
        pi = step(pi, row, like)
    penalty = 0.5 * np.log(size[:, 0] + 1)
    bic = fit_of(pi) - penalty * ((pi > 0).sum(axis=1) - 1)
    for _ in range(n_lang - 1):  # the smallest share leaves where that pays
        left = np.where(pi > 0, pi, 2).argmin(axis=1)
        can = (pi > 0).sum(axis=1) > 1
        if not can.any():
            break
        trial = pi.copy()
        trial[can, left[can]] = 0
        trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-12)
        for _ in range(2):
            trial = np.where(trial > 0, step(trial, row, like), 0)
            trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-12)
        got = fit_of(trial) - penalty * ((trial > 0).sum(axis=1) - 1)
        better = can & (got >= bic)
        if not better.any():
            break
        pi[better], bic[better] = trial[better], got[better]
    return pi, bic


def languages(text: Column, model: Model) -> Column:
    """A struct: lang_pred, score, and the languages found with their shares, largest first."""
    schema = "struct<lang_pred:string,score:double,langs:array<struct<lang:string,share:double>>>"

    @arrow_udf(schema)
    def found(column: pa.Array) -> pa.Array:
        preds, scores, sets = [], [], []
        for a, b in A.slices(column, (1 << 23) // max(8, len(model.langs))):  # a word has a number for each language
            part = column.slice(a, b - a)
            w = words_of(part)
            n = np.diff(w.first)
            if len(w.of) and model.langs:
                pair, times = np.unique(np.repeat(np.arange(b - a), n) * len(w.starts) + w.of, return_counts=True)
                row, of = np.divmod(pair, len(w.starts))
                pi, _ = mixtures(word_likelihoods(w, model)[of], row, times, b - a)
            else:
                pi = np.zeros((b - a, max(1, len(model.langs))))
            best = pi.argmax(axis=1)
            for r in range(b - a):
                if not n[r] or not model.langs:
                    preds.append("und")
                    scores.append(0.0)
                    sets.append([])
                    continue
                preds.append(model.langs[best[r]])
                scores.append(float(min(1.0, max(0.0, pi[r, best[r]]))))
                order = [j for j in np.argsort(-pi[r], kind="stable") if pi[r, j] > 0]
                sets.append([{"lang": model.langs[j], "share": float(pi[r, j])} for j in order])
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], ["lang_pred", "score", "langs"])

    return found(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose language is not learned from. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score, langs."""
    return docs.select(F.col(id_col), languages(F.col(text_col), model).alias("_l")).select(id_col, held_out(id_col).alias("held_out"), "_l.lang_pred", "_l.score", "_l.langs")
