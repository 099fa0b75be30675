"""Where plans register themselves, and what stands in for the speeches: documents with derived dates, sides and topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import period, quarter_of
from ..sources.readers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with d, quarter, period, side3, party_name, bloc_combined and a rule-based topic (-1: outlier)."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    side = F.when(n <= 7, "Left").when(n <= 15, "Right").when(n <= 17, "Center").when(n == 18, "M5S")
    out = docs.withColumn("d", F.date_add(F.lit("2018-01-01").cast("date"), (F.col("doc_id") * 37 % 1733).cast("int"))).withColumn("side3", side)
    out = out.withColumn("quarter", quarter_of(F.col("d"))).withColumn("period", period(F.col("quarter"))).withColumn("party_name", F.col("source"))
    out = out.withColumn("bloc_combined", F.when(F.col("side3").isin("Center", "M5S"), "Center+M5S").otherwise(F.col("side3")))
    return out.withColumn("topic", (F.col("doc_id") % 7 - 1).cast("int"))


#: The same as ``speeches``, for DuckDB; and tokens as lists.
SPEECH = """speech AS (
  SELECT *, CAST(year(d) AS VARCHAR) || 'q' || CAST(quarter(d) AS VARCHAR) AS quarter,
    CASE WHEN d >= DATE '2020-04-01' THEN 'post' ELSE 'pre' END AS period, source AS party_name,
    CASE WHEN side3 IN ('Center', 'M5S') THEN 'Center+M5S' ELSE side3 END AS bloc_combined, CAST(doc_id % 7 - 1 AS INTEGER) AS topic
  FROM (SELECT *, DATE '2018-01-01' + CAST(doc_id * 37 % 1733 AS INTEGER) AS d,
      CASE WHEN n <= 7 THEN 'Left' WHEN n <= 15 THEN 'Right' WHEN n <= 17 THEN 'Center' WHEN n = 18 THEN 'M5S' END AS side3
    FROM (SELECT *, TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents)))"""
T1 = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda t: length(t) > 2)"
T2 = f"list_filter({T1}, lambda t: regexp_full_match(t, '[A-Za-zÀ-ÿ]{{3,}}'))"
T3 = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '')"


def tokens(kind: str, keep: str = "doc_id, quarter, side3, period, topic") -> str:
    """CTE tok (keep, term) of one row for each token."""
    return f"{SPEECH}, tok AS (SELECT {keep}, unnest({kind}) AS term FROM speech)"


def log_odds_cte(source: str, by: str = "", prior: str = "0.01") -> str:
    """CTE z (by, term, a, b, ta, tb, log_odds, z) from a relation (by, term, a, b)."""
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    keep = f"{by}, " if by else ""
    return f"""tot AS (SELECT {keep}term, a, b, sum(a) {over} AS ta, sum(b) {over} AS tb, count(*) {over} AS v FROM {source}),
p AS (SELECT *, (a + {prior}) / (ta + {prior} * v) AS pa, (b + {prior}) / (tb + {prior} * v) AS pb FROM tot),
lo AS (SELECT *, ln(pa / nullif(1 - pa, 0)) - ln(pb / nullif(1 - pb, 0)) AS log_odds FROM p),
z AS (SELECT *, log_odds / sqrt(1 / (a + {prior}) + 1 / (b + {prior})) AS z FROM lo)"""
