"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where that is unset and all tasks run in the
    driver's process (tests, one machine) is a temporary folder made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinsift-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in _own.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before; the folder is scratch space
            pass
    _own.clear()


atexit.register(_clean)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read again. Lost executors lose
    nothing of it. The files go with `discard`, or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/kinsift-{name}-{uuid.uuid4().hex}"
    _own[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinsift_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing will read any more."""
    for t in tables:
        path = getattr(t, "_kinsift_path", None)
        if path in _own:
            _delete(_own.pop(path), path)


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has (names don't depend on case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch: texts can be long, and a batch is held in memory whole. For
    applications (queries, the pipeline): it sets the session, which operators don't."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
