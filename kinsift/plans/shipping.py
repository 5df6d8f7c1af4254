"""The package on the executors' path, where nothing else has put it there."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package once per application, unless workers start where they find it."""
    found = {os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    app = spark.sparkContext.applicationId
    if str(ROOT) in found or app in _sent:
        return
    d = tempfile.mkdtemp(prefix="kinsift-")  # the driver serves the archive as long as it runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/kinsift", "zip", ROOT, "kinsift"))
    _sent.add(app)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
