"""Similarity of candidate pairs: matching features, words of the rest, and titles.

variant 'exact': Dice on q-grams as they are, title words as sets, an empty feature map gives no
feature weight. variant 'fast': Jaccard on lower-cased q-grams, title words with repeats, 1e-8 added to
the number of features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.functions import text as T
from kinsift.plans import scratch


@dataclass(frozen=True)
class Weights:
    alpha: float = 0.602
    beta: float = 0.000
    gamma: float = 0.756
    mu: float = 0.650
    delta: float = 0.5


WEIGHTS = Weights()


def _grams(c: Column, variant: str) -> Column:
    return T.qgrams(c, 3, lower=variant == "fast")


def _similar(a: Column, b: Column, variant: str) -> Column:
    return T.jaccard(a, b) if variant == "fast" else T.dice(a, b)


def key_similarity(features: DataFrame, gamma: float = WEIGHTS.gamma, variant: str = "exact") -> DataFrame:
    """k1, k2, key_sim > gamma over all distinct keys.

    Keys that similar share a q-gram: an equi-join on q-grams counts what two keys have in common;
    no pair of unrelated keys is made."""
    keys = features.select("key").distinct().withColumn("g", _grams(F.col("key"), variant)).withColumn("n", F.size("g"))
    grams = keys.select("key", "n", F.explode("g").alias("g"))
    a, b = grams.select(F.col("key").alias("k1"), F.col("n").alias("n1"), "g"), grams.select(F.col("key").alias("k2"), F.col("n").alias("n2"), "g")
    common = a.join(b, "g").groupBy("k1", "k2", "n1", "n2").agg(F.count("*").alias("c"))
    sim = F.col("c") / (F.col("n1") + F.col("n2") - F.col("c")) if variant == "fast" else 2.0 * F.col("c") / (F.col("n1") + F.col("n2"))
    return common.select("k1", "k2", sim.alias("key_sim")).where(F.col("key_sim") > gamma)


def key_matches(pairs: DataFrame, features: DataFrame, gamma: float = WEIGHTS.gamma, variant: str = "exact") -> DataFrame:
    """i, j, k1, k2, key_sim, value_sim of all key pairs over gamma; not one-to-one.

    The theta join of keys becomes two equi-joins by way of key_similarity()."""
    f = features.withColumn("g", _grams(F.coalesce("value", F.lit("none")), variant))
    a = f.select(F.col("product_idx").alias("i"), F.col("key").alias("k1"), F.col("g").alias("g1"))
    b = f.select(F.col("product_idx").alias("j"), F.col("key").alias("k2"), F.col("g").alias("g2"))
    found = pairs.join(a.hint("merge"), "i").join(key_similarity(features, gamma, variant), "k1").join(b.hint("merge"), ["j", "k2"])
    return found.select("i", "j", "k1", "k2", "key_sim", _similar(F.col("g1"), F.col("g2"), variant).alias("value_sim"))


def kv_match(matches: DataFrame) -> DataFrame:
    """i, j, m (matches), w (their weight), kv (weighted similarity of values)."""
    return matches.groupBy("i", "j").agg(F.count("*").alias("m"), F.sum("key_sim").alias("w"), (F.sum(F.col("key_sim") * F.col("value_sim")) / F.sum("key_sim")).alias("kv"))


def unmatched_keys(pairs: DataFrame, features: DataFrame, matches: DataFrame) -> DataFrame:
    """i, j, side ('i' or 'j'), key, value of features that match none of the other product."""
    out = []
    for side, k in (("i", "k1"), ("j", "k2")):
        own = pairs.join(features.select(F.col("product_idx").alias(side), "key", "value").hint("merge"), side)
        out.append(own.join(matches.select("i", "j", F.col(k).alias("key")).distinct().hint("merge"), ["i", "j", "key"], "left_anti").select("i", "j", F.lit(side).alias("side"), "key", "value"))
    return out[0].unionByName(out[1])


def hsm(unmatched: DataFrame) -> DataFrame:
    """i, j, hsm: Jaccard similarity of the words of unmatched values of both sides."""
    words = unmatched.withColumn("word", T.value_word(F.col("value")))
    sets = words.groupBy("i", "j").agg(F.collect_set(F.when(F.col("side") == "i", F.col("word"))).alias("a"), F.collect_set(F.when(F.col("side") == "j", F.col("word"))).alias("b"))
    return sets.select("i", "j", T.jaccard(F.col("a"), F.col("b")).alias("hsm"))


def title_pairs(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """i, j, t1, t2."""
    p = products.select("product_idx", F.coalesce("title", F.lit("none")).alias("t"))
    return pairs.join(p.select(F.col("product_idx").alias("i"), F.col("t").alias("t1")).hint("merge"), "i").join(p.select(F.col("product_idx").alias("j"), F.col("t").alias("t2")).hint("merge"), "j")


def _weighted(a: Column, b: Column, term) -> Column:
    """Sum of w * s over sum of w, for (s, w) = term(x, y) over all x of a and y of b; 0 without weight."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))

    def add(s: Column, x: Column, y: Column) -> Column:
        sim, w = term(x, y)
        return F.struct((s["n"] + sim * w).alias("n"), (s["d"] + w).alias("d"))

    return F.aggregate(a, zero, lambda s, x: F.aggregate(b, s, lambda t, y: add(t, x, y)), lambda s: F.coalesce(F.try_divide(s["n"], s["d"]), F.lit(0.0)))


def average_edit(a: Column, b: Column) -> Column:
    """Average similarity by Levenshtein's distance over all pairs of words, weighted by their lengths."""
    return _weighted(a, b, lambda x, y: (1 - T.edit_distance(x, y), (F.length(x) + F.length(y)).cast("double")))


def parted(words: Column) -> Column:
    """Model words with their numeric and other parts."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), T.numeric_part(w).alias("n"), T.other_part(w).alias("o")))


def _near(x: Column, y: Column) -> Column:
    return T.edit_distance(x["o"], y["o"]) < 0.5


def average_edit_words(a: Column, b: Column) -> Column:
    """The same over pairs of parted model words that agree: other parts near, numbers equal."""
    return _weighted(a, b, lambda x, y: (1 - T.edit_distance(x["w"], y["w"]), F.when(_near(x, y) & (x["n"] == y["n"]), (F.length(x["w"]) + F.length(y["w"])).cast("double")).otherwise(0.0)))


def split_words(title: Column, variant: str) -> Column:
    """Words between white space; 'exact': once each."""
    return F.filter(F.split(title, r"(?U)\s+"), lambda w: w != "") if variant == "fast" else T.title_tokens(title)


def title_similarity(titled: DataFrame, weights: Weights = WEIGHTS, variant: str = "exact") -> DataFrame:
    """i, j, cosine, tmwm: 1 for titles of high cosine, -1 for model words in conflict, else a
    blend of edit distances. Titles of high cosine skip the comparison of words."""
    words = lambda t: split_words(t, variant)
    d = titled.withColumn("cosine", T.token_cosine(F.col("t1"), F.col("t2")))
    d = d.withColumn("m1", parted(T.title_words(F.col("t1")))).withColumn("m2", parted(T.title_words(F.col("t2"))))
    some = lambda test: F.exists("m1", lambda x: F.exists("m2", lambda y: _near(x, y) & test(x, y)))
    base = weights.beta * F.col("cosine") + (1 - weights.beta) * average_edit(words(F.col("t1")), words(F.col("t2")))
    blend = weights.delta * average_edit_words(F.col("m1"), F.col("m2")) + (1 - weights.delta) * base
    score = F.when(F.col("cosine") > weights.alpha, F.lit(1.0)).when(some(lambda x, y: x["n"] != y["n"]), F.lit(-1.0)).when(some(lambda x, y: x["n"] == y["n"]), blend).otherwise(base)
    return d.select("i", "j", "cosine", score.alias("tmwm"))


def alike_features(pairs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products of equal features stand for each other: product_idx, like (the least of its kind), n (features) of products that have
    some; i, j of the kinds that the pairs are between, once; the features of the kinds. One without features is of its own kind."""
    maps = features.groupBy("product_idx").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("all"))
    kinds = maps.groupBy("all").agg(F.min("product_idx").alias("like"), F.collect_list("product_idx").alias("members"))
    like = scratch.written(kinds.select("like", F.size("all").alias("n"), F.explode("members").alias("product_idx")), "like")
    at = lambda k: like.select(F.col("product_idx").alias(k), F.col("like").alias(f"like_{k}")).hint("merge")
    tagged = pairs.join(at("i"), "i", "left").join(at("j"), "j", "left")
    few = scratch.written(tagged.select(F.coalesce("like_i", "i").alias("i"), F.coalesce("like_j", "j").alias("j")).distinct(), "kinds")
    return like, few, features.join(like.where("product_idx = like").select("product_idx").hint("merge"), "product_idx", "left_semi")


def pair_similarity(pairs: DataFrame, products: DataFrame, features: DataFrame, weights: Weights = WEIGHTS, variant: str = "exact") -> DataFrame:
    """i, j, similarity (not clamped: matches are not one-to-one) and its parts m, kv, hsm, tmwm."""
    like, few, own = alike_features(pairs, features)
    matches = key_matches(few, own, weights.gamma, variant)
    at = lambda k: like.select(F.col("product_idx").alias(k), F.col("like").alias(f"like_{k}"), F.col("n").alias(f"n{k}"))
    each = few.join(kv_match(matches).hint("merge"), ["i", "j"], "left").join(hsm(unmatched_keys(few, own, matches)).hint("merge"), ["i", "j"], "left")
    d = title_similarity(title_pairs(pairs, products), weights, variant)
    d = d.join(at("i").hint("merge"), "i", "left").join(at("j").hint("merge"), "j", "left").withColumn("like_i", F.coalesce("like_i", "i")).withColumn("like_j", F.coalesce("like_j", "j"))
    d = d.join(each.withColumnsRenamed({"i": "like_i", "j": "like_j"}).hint("merge"), ["like_i", "like_j"], "left")
    zero = F.lit(0)
    m, kv, h = F.coalesce("m", zero), F.coalesce("kv", F.lit(0.0)), F.coalesce("hsm", F.lit(0.0))
    least = F.least(F.coalesce("ni", zero), F.coalesce("nj", zero))
    share = m / (least + F.lit(1e-8)) if variant == "fast" else F.coalesce(F.try_divide(m, least), F.lit(0.0))
    theta = (1 - weights.mu) * share
    sim = F.when(F.col("tmwm") == -1, share * kv + (1 - share) * h).otherwise(theta * kv + (1 - weights.mu - theta) * h + weights.mu * F.col("tmwm"))
    return d.select("i", "j", m.alias("m"), kv.alias("kv"), h.alias("hsm"), "tmwm", sim.alias("similarity"))


def dissimilarity(similar: DataFrame) -> DataFrame:
    """i, j, dissim of evaluated pairs; all others are infinitely far."""
    return similar.select("i", "j", (1 - F.col("similarity")).alias("dissim"))
