"""Results of experiments: read with a fixed schema, written by configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = (
    "bootstrap int, r int, b int, t double, candidate_pairs long, duplicates_found_lsh long, duplicates_found_msm long, "
    "foc_lsh double, pq_lsh double, pc_lsh double, f1_star double, foc_msm double, pq_msm double, pc_msm double, f1 double"
)
METRICS = ("candidate_pairs", "duplicates_found_lsh", "duplicates_found_msm", "foc_lsh", "pq_lsh", "pc_lsh", "f1_star", "foc_msm", "pq_msm", "pc_msm", "f1")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What write_results has written; empty where nothing is there yet."""
    return spark.read.schema(RESULTS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], RESULTS)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("bootstrap").parquet(path)


def read_json_results(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of results whose band configuration is the list "(r,b)"; empty without a file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], RESULTS)
    names = [f.split() for f in RESULTS.split(", ") if f.split()[0] not in ("r", "b")]
    schema = "array<struct<" + ",".join(f"{n}:{k}" for n, k in names) + ",`(r,b)`:array<int>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("x")).select("x.*")
    rb = F.col("`(r,b)`")
    return rows.withColumn("r", rb[0]).withColumn("b", rb[1]).select(*(f.split()[0] for f in RESULTS.split(", ")))
