"""Model words of products: from titles and feature values to an indexed, sparse relation.

The binary matrix of words by products is the relation (product_idx, word_idx) of its ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsift.functions import text as T


def dense_index(df: DataFrame, key: str, bucket: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the rank of key from 0 (within groups of `by`) in column `name`.

    bucket: an expression that is monotone in key and takes few values; ranks are counted within
    buckets and offset by the sizes of the buckets before, so that no task sees all rows, only a row a bucket."""
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).alias("_before")
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key)))
    return ranked.join(sizes.select(*by, "_b", before), [*by, "_b"]).withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_b", "_before", "_r")


def feature_frequency(features: DataFrame) -> DataFrame:
    """Products per raw key."""
    return features.groupBy("key").agg(F.count("*").alias("n_products"))


def relevant_features(features: DataFrame, n_products: int, share: float = 0.10) -> DataFrame:
    """Keys of share * n_products products or more."""
    return feature_frequency(features).where(F.col("n_products") >= F.lit(share) * F.lit(n_products)).select("key")


def basic_words(products: DataFrame, features: DataFrame) -> DataFrame:
    """product_idx, word: words of titles, and the numbers at the end of values."""
    titles = products.select("product_idx", F.explode(T.title_words(F.col("title"))).alias("word"))
    values = features.select("product_idx", T.value_word(F.col("value")).alias("word")).where("word IS NOT NULL")
    return titles.unionByName(values).distinct()


def unified_words(products: DataFrame, features: DataFrame, relevant: DataFrame) -> DataFrame:
    """product_idx, word: words of titles and of the values of relevant keys."""
    titles = products.select("product_idx", F.explode(T.title_words(F.col("title"))).alias("word"))
    own = features.join(F.broadcast(relevant), "key", "left_semi")  # keys that a share of all products has: few
    values = own.select("product_idx", F.explode(T.title_words(F.col("value"))).alias("word"))
    return titles.unionByName(values).distinct()


def vocabulary(words: DataFrame) -> DataFrame:
    return words.select("word").distinct()


def word_index(words: DataFrame) -> DataFrame:
    """word, word_idx: the rank of each word in code point order."""
    return dense_index(vocabulary(words), "word", F.substring("word", 1, 2), "word_idx")


def product_words(words: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The ones of the binary matrix."""
    return words.join((word_index(words) if index is None else index).hint("merge"), "word").select("product_idx", "word_idx")


def sample_columns(relation: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of a relation by product_idx for each drawn product, copies included."""
    return samples.join(relation, "product_idx")
