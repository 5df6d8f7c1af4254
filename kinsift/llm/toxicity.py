"""Toxicity by a weighted lexicon.

Texts are folded (lower case, accents kept, homoglyphs and digit substitutions to the letters
they imitate), cut into words, and matched by an Aho-Corasick automaton that holds the terms
of the lexicon. A term is a whole word or a stem that begins words. Exceptions are phrases of two words, one of them a
term, or words that begin with a stem: a term counts for nothing there. The score is a logistic
function of the weight found, as it is and per hundred words, so that the length of a text is taken into account.

The lexicon, the exceptions and the logistic function are learned from labelled texts. Equal texts
count once, and a term is counted by the different neighbours that it has, so that a text that is copied with small changes
lends its words no weight. What makes a term is a test of significance (for as many trials
as there are terms), so that rare words count on any size of the sample if their texts are toxic enough; none is cut off
by rank. Exceptions are found first, and terms are then judged by their other occurrences.

Nulls: a null or empty text, or one without a letter, has the score of no hit; rows without an id, text or label are not learned from;
a row without an id is held out. Rows that repeat an id with different labels are toxic if one is. Repeated rows are scored each by itself.
Without labels of both kinds every text gets the same score, near the label that there is (0 without any). Empty tables
give empty results. Very long texts are scored whole. Ties: of terms that begin at one word, the shortest counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kinsift.plans import scratch

#: Letters of other scripts, digits and signs that imitate a Latin letter.
HOMOGLYPHS = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
})
_OUTSIDE = r"[^\p{L}\p{M}]+"
FIT_ROWS = 20_000


@dataclass
class Model:
    """Weights of whole words and of stems, exceptions (phrases of two words, and single words that begin with a stem), and the logistic
    function's offset and factors."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, ...]] = frozenset()
    factors: tuple[float, float, float] = (-3.0, 1.0, 0.0)


def folded(text: str) -> str:
    return text.lower().translate(HOMOGLYPHS)


def automaton(model: Model):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in model.words:
        found.add_word(f" {term} ", (term, model.words[term], True))
    for term in model.stems:
        found.add_word(f" {term}", (term, model.stems[term], False))
    if len(found):
        found.make_automaton()
    return found


def spaced(text: str) -> str:
    """Folded words, each with a space before and after it."""
    import regex

    global _SPLIT
    if _SPLIT is None:
        _SPLIT = regex.compile(_OUTSIDE)
    return f" {_SPLIT.sub(' ', folded(text)).strip()} "


_SPLIT = None


def weigh(text: str | None, model: Model, terms) -> tuple[float, float, int, int]:
    """Weight found, weight per hundred words, hits, words."""
    if not text:
        return 0.0, 0.0, 0, 0
    line = spaced(text)
    n = line.count(" ") - 1
    if n < 1 or not len(terms):
        return 0.0, 0.0, 0, max(n, 0)
    total, hits, last = 0.0, 0, -1
    for end, (term, weight, whole) in terms.iter(line):
        start = end - len(term) - whole
        if start == last:  # a longer term at the same word
            continue
        if model.exceptions:
            stop = line.index(" ", start + 1)
            word = line[start + 1 if line[start] == " " else start : stop]
            before = line[line.rfind(" ", 0, max(start, 1)) + 1 : start] if start > 0 else ""
            after = line[stop + 1 : line.find(" ", stop + 1)]
            if not model.exceptions.isdisjoint(((word,), (before, word), (word, after))):
                continue
        last = start
        total += weight
        hits += 1
    return total, 100.0 * total / n, hits, n


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def scores(text: Column | str, model: Model) -> Column:
    """A struct of score (0 to 1), hits and words. A null or empty text has the score of no hit."""
    shared: dict = {}

    @arrow_udf("score double, n_hits bigint, n_words bigint")
    def scored(column: pa.Array) -> pa.Array:
        terms = automaton(model) if "terms" not in shared else shared["terms"]
        shared["terms"] = terms
        a, b, c = model.factors
        rows = [weigh(t.as_py(), model, terms) for t in column]
        return pa.StructArray.from_arrays([
            pa.array([logistic(a + b * math.log1p(max(0.0, w)) + c * math.log1p(max(0.0, per))) for w, per, _, _ in rows], pa.float64()),
            pa.array([h for _, _, h, _ in rows], pa.int64()), pa.array([n for _, _, _, n in rows], pa.int64()),
        ], ["score", "n_hits", "n_words"])

    return scored(F.col(text) if isinstance(text, str) else text)


#: A term occurs with so many different neighbours in toxic texts, an exception in clean ones, at least; how pure a
#: term is; and the share of terms that may be there by chance.
LEAST, PURITY, FALSE_SHARE = 4, 0.9, 0.5


def chance(a: int, b: int, base: float) -> float:
    """Chernoff's bound, as a logarithm, of the chance that `a` texts of a + b are toxic where a part `base` of all is."""
    p = a / (a + b)
    if p <= base:
        return 0.0
    return -(a + b) * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


def significant(counts: dict[str, tuple[int, int]], base: float, trials: int, false_share: float = FALSE_SHARE) -> set[str]:
    """Terms of `trials` in all, so many that about `false_share` of them are there by chance (Benjamini and Hochberg)."""
    ranked = sorted((chance(a, b, base), u) for u, (a, b) in counts.items())
    most = max((k for k, (c, _) in enumerate(ranked, 1) if c <= math.log(false_share * k / max(1, trials))), default=0)
    return {u for _, u in ranked[:most]}


def _stems(word: str) -> list[str]:
    return [word[:k] for k in range(4, min(len(word), 10))]


def occurrences(seq: list[str], known=None) -> set[tuple[str, str, str, str]]:
    """(term, word, word before, word after) of the words (=word) and stems (^stem) of a text, or of those that are known."""
    out = set()
    for i, w in enumerate(seq):
        for u in ("=" + w, *("^" + x for x in _stems(w))):
            if known is None or u in known:
                out.add((u, w, seq[i - 1] if i else "", seq[i + 1] if i + 1 < len(seq) else ""))
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: int = LEAST, purity: float = PURITY) -> Model:
    """Learns a model from labelled rows (id, text, label 0/1; nulls in any of them are left out).

    Terms are words and stems (the first 4 to 9 letters) with `least` different neighbours in toxic texts or more,
    of whose texts, outside of exceptions, significantly many and a part of `purity` or more are toxic; a stem
    begins two such words or more. The rows are taken to be bounded by the caller (`training_rows`): what is fetched are
    terms with more toxic texts than chance gives and phrases with them, and three numbers a row."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y")).where("i IS NOT NULL AND t IS NOT NULL AND y IS NOT NULL")
    rows = rows.groupBy("t").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(factors=(4.0 if n1 else -4.0, 0.0, 0.0))
    base = n1 / (n1 + n0)
    schema = "array<struct<u:string,w:string,p:string,n:string>>"
    kind = pa.list_(pa.struct([(c, pa.string()) for c in "uwpn"]))

    def found(known=None):
        @arrow_udf(schema)
        def units(column: pa.Array) -> pa.Array:
            return pa.array([[dict(zip("uwpn", x, strict=True)) for x in sorted(occurrences(spaced(t.as_py()).split(), known))] for t in column], kind)

        return rows.select(F.xxhash64("t").alias("d"), "y", F.explode(units("t")).alias("x")).select("d", "y", "x.*")

    # terms that may be toxic if exceptions account for their clean texts; a text counts once
    @arrow_udf("array<string>")
    def names(column: pa.Array) -> pa.Array:
        words = (set(spaced(t.as_py()).split()) for t in column)
        return pa.array([[*("=" + w for w in ws), *{"^" + x for w in ws for x in _stems(w)}] for ws in words], pa.list_(pa.string()))

    counted = rows.select(F.explode(names("t")).alias("u"), "y").groupBy("u").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counted = scratch.written(counted, "terms")
    trials = counted.count()
    likely = {r["u"] for r in counted.where((F.col("a") >= least) & (F.col("a") >= 1.5 * base * (F.col("a") + F.col("b")))).collect()}
    scratch.discard(counted)
    if likely:
        uses = scratch.written(found(likely), "uses")
        sides = uses.select("d", "y", F.explode(F.array(F.struct(F.col("p").alias("one"), F.col("w").alias("two"), F.col("n").alias("beside")), F.struct(F.col("w").alias("one"), F.col("n").alias("two"), F.col("p").alias("beside")))).alias("x")).select("d", "y", "x.*").where("one <> '' AND two <> ''")
        tally = lambda df, *keys: df.groupBy(*keys).agg(F.count_distinct(F.when(F.col("y") == 1, F.col("d"))).alias("a"), F.count_distinct(F.when(F.col("y") == 0, F.col("d"))).alias("b"), F.count_distinct(F.when(F.col("y") == 0, F.col("beside"))).alias("c"))
        clean = f"c >= {least} AND a <= 0.1 * b"
        phrases = {(r["one"], r["two"]) for r in tally(sides, "one", "two").where(clean).collect()}
        endings = tally(uses.where("u LIKE '^%'").withColumn("beside", F.struct("p", "n")), "w").where(clean)
        words_out = {(r["w"],) for r in endings.collect()}
        exceptions = phrases | words_out

        @arrow_udf("boolean")
        def excepted(u: pa.Array, w: pa.Array, p: pa.Array, n: pa.Array) -> pa.Array:
            out = []
            for x, word, before, after in zip(u.to_pylist(), w.to_pylist(), p.to_pylist(), n.to_pylist(), strict=True):
                out.append((x[0] == "^" and (word,) in words_out) or (before, word) in phrases or (word, after) in phrases)
            return pa.array(out, pa.bool_())

        left = uses.where(~excepted("u", "w", "p", "n")) if exceptions else uses
        toxic = F.col("y") == 1
        judged = left.groupBy("u").agg(
            F.count_distinct(F.when(toxic, F.col("d"))).alias("a"), F.count_distinct(F.when(~toxic, F.col("d"))).alias("b"),
            F.count_distinct(F.when(toxic, F.struct("p", "n"))).alias("c"), F.count_distinct(F.when(toxic, F.col("w"))).alias("words"),
        ).where((F.col("c") >= least) & (F.col("a") >= purity * (F.col("a") + F.col("b")))).collect()
        sure = significant({r["u"]: (r["a"], r["b"]) for r in judged}, base, trials)
        kept = {r["u"]: r for r in judged if r["u"] in sure}
        scratch.discard(uses)
    else:
        kept, exceptions = {}, set()
    weight = lambda r: math.log((r["a"] + 0.25) / (n1 + 0.5)) - math.log((r["b"] + 0.25) / (n0 + 0.5))
    words = {u[1:]: r for u, r in kept.items() if u[0] == "="}
    stems: dict[str, object] = {}
    for s, r in sorted(((u[1:], r) for u, r in kept.items() if u[0] == "^"), key=lambda x: (len(x[0]), x[0])):
        if any(s.startswith(x) for x in stems) or r["words"] < 2:  # a shorter stem covers it; or it is a word
            continue
        if r["a"] > 1.15 * max((x["a"] for w, x in words.items() if w.startswith(s)), default=0):
            stems[s] = r
    words = {w: r for w, r in words.items() if not any(w.startswith(s) for s in stems)}
    model = Model({w: weight(r) for w, r in words.items()}, {s: weight(r) for s, r in stems.items()})
    used = lambda x: any(w in model.words or any(w.startswith(s) for s in model.stems) for w in x)
    model.exceptions = frozenset(x for x in exceptions if used(x))

    # the logistic function, from the weights of the rows
    @arrow_udf("total double, per double")
    def weights(column: pa.Array) -> pa.Array:
        terms = automaton(model)
        got = [weigh(t.as_py(), model, terms) for t in column]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())], ["total", "per"])

    data = np.array([tuple(r) for r in rows.select(weights("t").alias("w"), "y").select("w.total", "w.per", "y").collect()], float)
    x = np.column_stack([np.ones(len(data)), np.log1p(np.maximum(data[:, 0], 0)), np.log1p(np.maximum(data[:, 1], 0))])
    y, beta, ridge = data[:, 2], np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    model.factors = tuple(float(v) for v in beta)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are not learned from. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The labelled rows to learn from: of ids that are not held out, at most fit_rows. The ids
    are chosen before the texts are read, so that the join has a small side of fixed size."""
    chosen = labels.select(F.col(id_col).alias("_i"), F.col(label_col).alias("_y")).where(F.col("_i").isNotNull() & F.col("_y").isNotNull())
    chosen = chosen.withColumn("_h", F.xxhash64("_i")).where(~held_out("_i")).groupBy("_i", "_h").agg(F.max("_y").alias("_y")).orderBy("_h", "_i").limit(fit_rows)
    texts = docs.select(F.col(id_col), F.col(text_col))
    return texts.join(F.broadcast(chosen), texts[id_col] == F.col("_i")).select(F.col(id_col), F.col(text_col), F.col("_y").alias(label_col))


def learned(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """fit() on training_rows(), which are read once and kept as a small table meanwhile."""
    rows = scratch.written(training_rows(docs, labels, fit_rows=fit_rows), "toxic")
    model = fit(rows)
    scratch.discard(rows)
    return model


def toxic(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted, n_hits, n_words."""
    found = docs.select(F.col(id_col), scores(F.col(text_col), model).alias("_s"))
    return found.select(id_col, held_out(id_col).alias("held_out"), "_s.score", (F.col("_s.score") >= threshold).cast("int").alias("predicted"), "_s.n_hits", "_s.n_words")
