"""Shares, cross-tables, pivots and percentiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import after


def not_false(df: DataFrame, *flags: str) -> DataFrame:
    """Rows without a false flag; missing flags stay."""
    for f in flags:
        df = df.filter(~F.col(f).eqNullSafe(F.lit(False)))
    return df


def crosstab(df: DataFrame, flag: str, side: str = "side3", quarter: str = "quarter") -> DataFrame:
    """(side, period, flag, n, column_percent): period is 1 after 2020q2; missing flags go."""
    n = df.filter(F.col(flag).isNotNull()).groupBy(side, after(F.col(quarter)).alias("period"), flag).agg(F.count("*").alias("n"))
    column = F.sum("n").over(Window.partitionBy(side, "period"))
    return n.withColumn("column_percent", F.round(100.0 * F.col("n") / column, 6))


def shares(df: DataFrame, flag: str, *by: str) -> DataFrame:
    """(by, share_health): percentage of rows with the flag, rounded half to even; missing flags count as false, missing groups go."""
    for c in by:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*by).agg(F.bround(F.avg(F.coalesce(flag, F.lit(False)).cast("double")) * 100, 2).alias("share_health"))


def aligned_shares(all_rows: DataFrame, some: DataFrame, by: str) -> DataFrame:
    """(by, total, n_health, share_health) with groups that only one of the two has; a missing share is 0."""
    a = all_rows.groupBy(by).agg(F.count("*").alias("total"))
    b = some.groupBy(by).agg(F.count("*").alias("n_health"))
    got = a.join(b, by, "full")
    share = F.coalesce(F.try_divide(F.col("n_health"), F.col("total")) * 100, F.lit(0.0))
    return got.select(by, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_health", F.lit(0)).alias("n_health"), F.bround(share, 2).alias("share_health"))


def pivoted(df: DataFrame, by: str, column: str, names: Mapping[str, str]) -> DataFrame:
    """Counts of by x column, spread over columns named for the given values; 0 where there are none."""
    wide = df.filter(F.col(column).isNotNull()).groupBy(by).pivot(column, list(names)).count().na.fill(0)
    return wide.select(by, *[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def percentiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """(p, value), exact, interpolated."""
    found = df.agg(F.percentile(column, F.array(*[F.lit(p) for p in at])).alias("v"))
    return found.select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*[F.lit(p) for p in at]), F.col("i") + 1).alias("p"), F.round("value", 6).alias("value"))
