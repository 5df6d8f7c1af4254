"""Listings as a stream: the stateless steps, from raw titles to model words.

Cleaning and word extraction are Column functions, so they are the same for batches and streams.
Signatures, blocking and clustering need a whole table and are batch operators; foreachBatch
gives each batch of new listings to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.functions import text as T
from kinsift.sources.products import PRODUCT_SCHEMA


def read(spark: SparkSession, path: str) -> DataFrame:
    """New files of JSON lines of products."""
    return spark.readStream.schema(PRODUCT_SCHEMA).json(path)


def cleaned(listings: DataFrame, cleaner: T.Cleaner = T.clean_unified) -> DataFrame:
    return listings.withColumn("title", cleaner(F.col("title"))).withColumn("features", T.clean_map(F.col("features"), cleaner))


def words(listings: DataFrame) -> DataFrame:
    """product_idx, word of each listing, once."""
    values = F.flatten(F.transform(F.map_values("features"), T.title_words))
    return listings.select("product_idx", F.explode(F.array_distinct(F.concat(T.title_words(F.col("title")), values))).alias("word"))


def for_each(listings: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that gives each batch of listings to act."""
    return listings.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
