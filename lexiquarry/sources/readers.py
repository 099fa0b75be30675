"""Readers and writers of speech tables, with explicit schemas and the fallbacks for separators and encodings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = (",", ";", "\t")
#: The analysis' own subset, and the one by another topic model that checks it.
DATASETS = ("main", "robust")


def dataset(spark: SparkSession, which: str, paths: dict[str, str]) -> DataFrame:
    """The subset to analyse, from Parquet."""
    if which not in DATASETS:
        raise ValueError(f"unknown dataset {which!r}")
    return read_parquet(spark, paths[which])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
    return f"{base.rstrip('/')}/lexiquarry-{name}-{uuid.uuid4().hex}"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A missing path raises AnalysisException."""
    return spark.read.parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan that has fewer tasks than there are cores, dealt over all of them; a larger one as it is.

    A file of few row groups is read by few tasks, and its texts would then be tokenised by these alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def separator(spark: SparkSession, path: str) -> str:
    """The separator that the header line has most of."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(SEPARATORS, key=line.count)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str | None = None) -> DataFrame:
    """A table with a header, read as UTF-8, or as Latin-1 where its bytes aren't UTF-8.

    Quoted fields may hold separators, quotes, line feeds and white space; an empty field is null, a quoted empty one
    isn't. Use string columns for uncertain types and cast later.
    """
    reader = spark.read.schema(schema).option("header", True).option("sep", sep or separator(spark, path)).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    reader = reader.option("nullValue", f"null-{uuid.uuid4().hex}")  # what an empty field becomes, so that it differs from ""
    broken = spark.read.text(path).filter("not is_valid_utf8(value)")
    return reader.option("encoding", "UTF-8" if broken.isEmpty() else "ISO-8859-1").csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    """UTF-8 with a header, white space kept; ``one_file`` for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def save_figure(figure, folder: str, name: str) -> list[str]:
    """Writes a matplotlib figure as PNG and PDF on the driver; the engine itself returns the series to plot."""
    import os

    os.makedirs(folder, exist_ok=True)
    paths = [os.path.join(folder, f"{name}.{kind}") for kind in ("png", "pdf")]
    for p in paths:
        figure.savefig(p, dpi=300, bbox_inches="tight")
    return paths
