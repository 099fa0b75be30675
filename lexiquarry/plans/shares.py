"""Shares and cross-tables of flagged speeches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shares as ops
from .catalog import SPEECH, plan, speeches

#: Labelled documents stand in for flagged speeches: quality for keywords, length for the semantic route.
_FLAGS = f"""{SPEECH}, f AS (SELECT speech.*, labels.quality = 1 AS by_keywords, CASE WHEN labels.quality IS NOT NULL THEN n_chars > 1500 END AS by_semantic
  FROM speech LEFT JOIN labels ON speech.doc_id = labels.doc_id),
flags AS (SELECT *, by_keywords OR by_semantic AS is_union, by_keywords AND by_semantic AS is_both FROM f)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    f = speeches(spark, sf_dir).join(labels, "doc_id", "left")
    f = f.withColumn("by_keywords", F.col("quality") == 1).withColumn("by_semantic", F.when(F.col("quality").isNotNull(), F.col("n_chars") > 1500))
    return f.withColumn("is_union", F.col("by_keywords") | F.col("by_semantic")).withColumn("is_both", F.col("by_keywords") & F.col("by_semantic"))


@plan(f"WITH {_FLAGS} SELECT doc_id, coalesce(by_keywords, FALSE) AS is_health_by_keywords, coalesce(by_semantic, FALSE) AS is_health_by_semantic, coalesce(is_union, FALSE) AS is_health_union, coalesce(is_both, FALSE) AS is_health_intersection FROM flags")
def health_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    false = F.lit(False)
    named = {"is_health_by_keywords": "by_keywords", "is_health_by_semantic": "by_semantic", "is_health_union": "is_union", "is_health_intersection": "is_both"}
    return _flags(spark, sf_dir).select("doc_id", *[F.coalesce(c, false).alias(n) for n, c in named.items()])


@plan(f"WITH {_FLAGS} SELECT doc_id FROM flags WHERE is_both")
def health_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).filter("is_both").select("doc_id")


@plan(f"WITH {_FLAGS} SELECT doc_id FROM flags WHERE by_keywords IS DISTINCT FROM FALSE AND by_semantic IS DISTINCT FROM FALSE AND is_both IS DISTINCT FROM FALSE AND is_union IS DISTINCT FROM FALSE")
def health_share_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops rows with a false flag; missing flags stay."""
    return ops.not_false(_flags(spark, sf_dir), "by_keywords", "by_semantic", "is_both", "is_union").select("doc_id")


@plan(f"WITH {_FLAGS}, c AS (SELECT side3, CAST(quarter > '2020q2' AS INTEGER) AS period, is_both, count(*) AS n FROM flags WHERE side3 IN ('Left', 'Right') AND is_both IS NOT NULL GROUP BY ALL) SELECT side3, period, is_both AS is_health, n, round(100.0 * n / sum(n) OVER (PARTITION BY side3, period), 6) AS column_percent FROM c")
def crosstab_health_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crosstab(_flags(spark, sf_dir).filter(F.col("side3").isin("Left", "Right")), "is_both").withColumnRenamed("is_both", "is_health")


_SHARE = "round_even(avg(CAST(coalesce(is_union, FALSE) AS DOUBLE)) * 100, 2)"


@plan(f"WITH {_FLAGS} SELECT bloc_combined, quarter, {_SHARE} AS share_health FROM flags WHERE bloc_combined IS NOT NULL GROUP BY ALL")
def share_by_bloc_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shares(_flags(spark, sf_dir), "is_union", "bloc_combined", "quarter")


@plan(f"WITH {_FLAGS} SELECT quarter, {_SHARE} AS share_health FROM flags GROUP BY quarter")
def share_by_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.shares(_flags(spark, sf_dir), "is_union", "quarter")


@plan(
    f"""WITH {_FLAGS}, a AS (SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS total FROM flags GROUP BY 1), h AS (SELECT CAST(year(d) AS INTEGER) AS year, count(*) AS n FROM flags WHERE is_both GROUP BY 1)
SELECT coalesce(a.year, h.year) AS year, coalesce(total, 0) AS total, coalesce(n, 0) AS n_health, round_even(coalesce(n / total * 100, 0), 2) AS share_health FROM a FULL JOIN h ON a.year = h.year"""
)
def share_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _flags(spark, sf_dir).withColumn("year", F.year("d"))
    return ops.aligned_shares(rows, rows.filter("is_both"), "year")


@plan(f"WITH {SPEECH} SELECT quarter, bloc_combined, count(*) AS n FROM speech WHERE bloc_combined IS NOT NULL GROUP BY ALL")
def speeches_per_quarter_bloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeches(spark, sf_dir).filter("bloc_combined is not null").groupBy("quarter", "bloc_combined").agg(F.count("*").alias("n"))


@plan(f"WITH {SPEECH} SELECT quarter, count(*) FILTER (bloc_combined = 'Left') AS Left_n, count(*) FILTER (bloc_combined = 'Right') AS Right_n, count(*) FILTER (bloc_combined = 'Center+M5S') AS Center_n FROM speech WHERE bloc_combined IS NOT NULL GROUP BY quarter")
def pivot_quarter_bloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pivoted(speeches(spark, sf_dir), "quarter", "bloc_combined", {"Left": "Left_n", "Right": "Right_n", "Center+M5S": "Center_n"})


@plan(
    "SELECT CAST(p AS DOUBLE) AS p, round(v, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT {p} AS p, quantile_cont(n_chars, {p}) AS v FROM documents" for p in (0.5, 0.75, 0.85, 0.9, 0.95, 0.99)) + ")"
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.percentiles(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars", (0.5, 0.75, 0.85, 0.9, 0.95, 0.99))
