"""Quality rules as a learned decision list, in DataFrame and SQL functions only.

Statistics of a text are columns; a decision list is an ordered list of conjunctions of
thresholds on them, found by sequential covering: a rule grows by the threshold that gains
most, is pruned while that doesn't harm it on rows set aside, and the rows it covers leave
before the next rule. The list becomes one CASE expression.

Repeated windows are found inside the row, on arrays of 64-bit word hashes; nothing is shuffled.

A null text counts as empty; ratios of an empty text are 0. Rows without an id or label are not learned from; an id with several
labels counts by the least. Without labels of both kinds no rule is learned, and the base alone decides. Repeated rows are judged
each by itself, very long texts whole; only the id and the text are read, so that other columns can have any
name; an empty table gives an empty result. Ties between thresholds go to the feature and cut that come first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t-\r]+"  # \x20 and \x09 to \x0D
WINDOW = 8
FIT_ROWS = 20_000
#: What a rule may test; all are ratios or means, so that length alone decides nothing.
FEATURES = ("symbol_ratio", "upper_ratio", "exclaim_ratio", "digit_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "unique_ratio", "pipe_ratio", "stop_ratio")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda closes over is computed anew each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(h: Column, window: int = WINDOW) -> Column:
    """Words (of an array of hashes) inside a window that occurs twice or more."""
    starts = F.sequence(F.lit(1), F.size(h) - (window - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window)))
    zero = F.lit(0).cast("long")

    def twice(o: Column) -> Column:
        """Positions, in order, of the windows that equal a neighbour in the sorted array o."""
        hit = F.filter(o, lambda x, i: (x["k"] == F.get(o, i - 1)["k"]) | (x["k"] == F.get(o, i + 1)["k"]))
        return F.array_sort(F.transform(hit, lambda x: x["p"]))

    def length(at: Column) -> Column:
        """Words under the windows that begin at the sorted positions."""
        start = F.struct(zero.alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(at, start, lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(window))).alias("n"), p.alias("last")), lambda s: s["n"])

    def counted(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda k, p: F.struct(k.alias("k"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), zero).otherwise(length(let(ordered, twice)))

    return F.when(F.size(h) <= window, zero).otherwise(let(windows, counted))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: the id, `keep`, the counts and the features of rules. Words and lines are split once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    split = docs.select(F.col(id_col), *keep, t.alias("_t")).select(
        id_col, *keep, "_t", F.filter(F.split("_t", BLANK), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("_l"),
    )
    hashed = split.select(
        id_col, *keep, F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"), F.length(F.translate("_t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        count("!").alias("_ex"), count("0123456789").alias("_dg"), count("|").alias("_pi"), F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).alias("_up"),
        (count("\n") + 1).alias("_ln"), F.size(F.filter("_w", lambda w: F.length(w) <= 3)).alias("_st"),
    )
    counted = hashed.select(
        id_col, *keep, F.size("_h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("_h")).alias("n_repeat_words"),
        "_ex", "_dg", "_pi", "_up", "_ln", "_st", F.size(F.array_distinct("_h")).alias("_un"),
    )
    chars, words = F.col("word_chars"), F.col("n_words")
    return counted.select(
        id_col, *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio(F.col("n_symbols"), chars).alias("symbol_ratio"), ratio(F.col("_up"), chars).alias("upper_ratio"), ratio(F.col("_ex"), chars).alias("exclaim_ratio"), ratio(F.col("_dg"), chars).alias("digit_ratio"),
        ratio(F.col("n_dup_lines"), F.col("_ln")).alias("dup_line_ratio"), ratio(F.col("n_repeat_words"), words).alias("repeat_ratio"), ratio(chars, words).alias("mean_word"),
        ratio(F.col("_un"), words).alias("unique_ratio"), ratio(F.col("_pi"), words).alias("pipe_ratio"), ratio(F.col("_st"), words).alias("stop_ratio"),
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.cut) == self.above


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = self.tests[0].column()
        for t in self.tests[1:]:
            out = out & t.column()
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{t.feature} {'>' if t.above else '<='} {t.cut:.4g}" for t in self.tests)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information gained by narrowing (p0, n0) to (p1, n1), per positive that is kept."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def cover(rows: list[dict], most_rules: int = 8, most_tests: int = 3, bins: int = 32, least: int = 10, precision: float = 0.97) -> list[Rule]:
    """A decision list for rows with `bad` 0/1. A third of the rows prunes, the others grow; a
    rule is kept if `precision` of at least `least` covered rows are bad."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    cuts = {}
    for f in FEATURES:
        values = sorted(r[f] for r in rows)
        cuts[f] = sorted({values[min(len(values) - 1, len(values) * k // bins)] for k in range(1, bins)}) if values else []
    found: list[Rule] = []
    while len(found) < most_rules:
        tests: list[Test] = []
        left = grow
        while len(tests) < most_tests:
            p0 = sum(r["bad"] for r in left)
            n0 = len(left) - p0
            if not p0 or not n0:
                break
            best, best_gain = None, 1e-9
            for f in FEATURES:
                ordered = sorted((r[f], r["bad"]) for r in left)
                below_p, below_n, at = 0, 0, 0
                for c in cuts[f]:
                    while at < len(ordered) and ordered[at][0] <= c:
                        below_p, below_n, at = below_p + ordered[at][1], below_n + 1 - ordered[at][1], at + 1
                    for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                        if p >= max(2, least // 3) and (g := _gain(p0, n0, p, n)) > best_gain:
                            best, best_gain = Test(f, above, c), g
            if best is None:
                break
            tests.append(best)
            left = [r for r in left if best.holds(r)]
        if not tests:
            break

        def worth(ts: list[Test], on: list[dict]) -> float:
            """Laplace's estimate of the precision on the rows set aside."""
            hit = [r for r in on if all(t.holds(r) for t in ts)]
            return (sum(r["bad"] for r in hit) + 1) / (len(hit) + 2)

        while len(tests) > 1 and worth(tests[:-1], prune) >= worth(tests, prune):
            tests.pop()
        hit = [r for r in grow + prune if all(t.holds(r) for t in tests)]
        good = sum(r["bad"] for r in hit)
        if len(hit) < least or good < precision * len(hit):
            break
        found.append(Rule(tuple(tests), len(hit), good / len(hit)))
        grow, prune = ([r for r in part if not all(t.holds(r) for t in tests)] for part in (grow, prune))
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learns from labelled rows, at most fit_rows of them (the smallest hashes of the id; a
    bound of what is learned from, not of what is judged). Label 0 is bad. Without labels of
    both kinds the list is empty."""
    chosen = labels.select(F.col(id_col).alias("_i"), F.col(label_col).alias("_y")).where(F.col("_i").isNotNull() & F.col("_y").isNotNull())
    chosen = chosen.groupBy("_i").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_i"), "_i").limit(fit_rows)
    texts = docs.select(F.col(id_col), F.col(text_col))
    labelled = texts.join(F.broadcast(chosen), texts[id_col] == F.col("_i")).select(id_col, text_col, "_y")
    stats = statistics(labelled, id_col, text_col, keep=("_y",))
    usable = stats.where("n_words >= 20").orderBy(F.xxhash64(id_col), id_col, "_y", *FEATURES).limit(fit_rows)
    rows = [{f: r[f] for f in FEATURES} | {"bad": int(r["_y"] == 0)} for r in usable.select("_y", *FEATURES).collect()]
    return cover(rows)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, or null: one ordered CASE expression."""
    out = None
    for k, r in enumerate(rules):
        out = F.when(r.column(), F.lit(k)) if out is None else out.when(r.column(), F.lit(k))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts, base_failed, the number of the rule that holds, kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = statistics(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
