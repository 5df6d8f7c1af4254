"""From raw documents to a training mix.

Toxic documents go, near copies go but for one of each group, documents that hold passages of the
benchmark go, secrets are blotted out, and what is left is mixed to target weights of
its sources. Each stage gets what the one before has kept, written and read again.

Nulls: a null text is neither toxic, nor a copy, nor contaminated, and stays null; a null id is hashed as an empty one
in the mix; a null source is a source of its own. Of repeated rows and near copies one row stays. Ties go to
the least id. Columns beside those of documents go along; none is lost, and n_chars, if there is one, follows the
text where secrets are blotted out. Empty tables give an empty mix of the same columns (and those of the mix).

A stage may be run by itself: each sets the size of the session's Arrow batches, which are held in memory whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsift.llm import decontamination, mixing, near_dedup, secret_scan, toxicity
from kinsift.plans import scratch

#: Rows of an Arrow batch: what stages before have left in an executor's memory comes on top of it.
BATCH_ROWS = 250


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, which sets the session's batches however it is called."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.small_batches(spark, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.7."""
    model = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = scratch.unused(docs, "toxicity")
    return docs.withColumn(name, toxicity.scores(F.col("text"), model)).where(F.col(name)["score"] < 0.7).drop(name)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the least id."""
    return near_dedup.deduplicated(docs)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    name = scratch.unused(docs, "hits")
    return decontamination.flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=name).where(F.col(name)["n_hit"] == 0).drop(name)


@in_small_batches
def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the text."""
    left = secret_scan.redacted(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


@in_small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate and shuffled globally."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", blot_secrets),
    ("mixing", mix),
]
#: SQL can express neither the learned score nor the near copies; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.written(docs, name)
    return docs
