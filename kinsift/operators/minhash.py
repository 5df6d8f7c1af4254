"""MinHash signatures: k hash functions (a + b * x) mod p over word indexes."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 559692
WIDE = 64


def next_prime(n: int) -> int:
    """The least prime greater than n."""
    n += 1
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def signature_size(vocabulary: DataFrame) -> DataFrame:
    """n_words and k, the number of hash functions: half as many as there are words, rounded down."""
    return vocabulary.agg(F.count("*").alias("n_words")).select("n_words", F.floor(F.col("n_words") / 2).cast("int").alias("k"))


def parameters(k: int, seed: int = SEED) -> tuple[int, list[tuple[int, int]]]:
    """p and (a, b) of each function; a prime somewhat over k, drawn with the seed."""
    rng = random.Random(seed)
    p = next_prime(k + rng.randint(1, 5000))
    return p, [(rng.randint(1, p - 1), rng.randint(1, p - 1)) for _ in range(k)]


def parameter_table(spark: SparkSession, k: int, seed: int = SEED) -> DataFrame:
    p, pairs = parameters(k, seed)
    return spark.createDataFrame([(i, a, b, p) for i, (a, b) in enumerate(pairs)], "perm_id int, a long, b long, p long")


def signatures(product_words: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """product_idx, sig: an array of k minima. Products without words have no signature.

    Each function is an aggregate of its own in one pass, so that rows aren't multiplied by k before
    the partial aggregation; more than WIDE functions are explode-and-aggregate instead."""
    p, pairs = parameters(k, seed)
    x = F.col("word_idx")
    if k <= WIDE:
        least = [F.min((F.lit(a) + F.lit(b) * x) % p).alias(f"m{i}") for i, (a, b) in enumerate(pairs)]
        return product_words.groupBy("product_idx").agg(*least).select("product_idx", F.array(*(f"m{i}" for i in range(k))).alias("sig"))
    table = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(pairs)))
    long = product_words.select("product_idx", "word_idx", F.explode(table).alias("f")).groupBy("product_idx", F.col("f.i").alias("i")).agg(F.min((F.col("f.a") + F.col("f.b") * x) % p).alias("m"))
    return long.groupBy("product_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("sig"))


def long_form(sigs: DataFrame) -> DataFrame:
    """product_idx, perm_id, minhash."""
    return sigs.select("product_idx", F.posexplode("sig").alias("perm_id", "minhash"))


def agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """i, j, jaccard_estimate: the share of equal rows of two signatures."""
    a, b = sigs.select(F.col("product_idx").alias("i"), F.col("sig").alias("s1")), sigs.select(F.col("product_idx").alias("j"), F.col("sig").alias("s2"))
    equal = F.size(F.filter(F.zip_with("s1", "s2", lambda x, y: x == y), lambda z: z))
    return pairs.join(a, "i").join(b, "j").select("i", "j", (equal / F.size("s1")).alias("jaccard_estimate"))
