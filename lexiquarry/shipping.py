"""Makes this package importable on executors that don't have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each application."""
    if spark.sparkContext.applicationId in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lexiquarry-"), "lexiquarry.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "lexiquarry").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(path)
    _sent.add(spark.sparkContext.applicationId)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
