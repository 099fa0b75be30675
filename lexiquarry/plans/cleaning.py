"""Scans and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import day_first, year_and_quarter
from ..functions.text import fix_mojibake
from ..operators import cleaning as ops
from ..sources import readers
from .catalog import SPEECH, plan, speeches

_DATES = "(-1, '31/2/2020'), (-2, ''), (-3, '2020-01-05'), (-4, '5/1/2020'), (-5, 'abc'), (-6, '31/12/2017'), (-7, '1/1/2018'), (-8, NULL)"
_DATED = f"""dirty(doc_id, date) AS (VALUES {_DATES}),
rows AS (SELECT doc_id, CAST(day(d) AS VARCHAR) || '/' || CAST(month(d) AS VARCHAR) || '/' || CAST(year(d) AS VARCHAR) AS date FROM speech UNION ALL SELECT * FROM dirty)"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speeches(spark, sf_dir).select("doc_id", F.date_format("d", "d/M/yyyy").alias("date"))
    return s.unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, date FROM VALUES {_DATES} AS t(doc_id, date)"))


@plan(f"WITH {SPEECH}, {_DATED} SELECT doc_id, CAST(CAST(try_strptime(date, '%d/%m/%Y') AS DATE) AS VARCHAR) AS d FROM rows")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(spark, sf_dir).select("doc_id", day_first(F.col("date")).cast("string").alias("d"))


@plan(f"WITH {SPEECH}, {_DATED}, p AS (SELECT doc_id, CAST(try_strptime(date, '%d/%m/%Y') AS DATE) AS d FROM rows) SELECT doc_id, CAST(d AS VARCHAR) AS d, CAST(year(d) AS INTEGER) AS year FROM p WHERE d > DATE '2017-12-31'")
def date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dated(_dated(spark, sf_dir)).select("doc_id", F.col("d").cast("string").alias("d"), "year")


@plan(f"WITH {SPEECH} SELECT doc_id, quarter, CAST(year(d) AS INTEGER) AS year FROM speech")
def quarter_of_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeches(spark, sf_dir).select("doc_id", "quarter", F.year("d").alias("year"))


_BLANKS = "(-1, '  a b  ', 'x'), (-2, '   ', ''), (-3, NULL, ' y'), (-4, '\t', 'z ')"


@plan(f"SELECT doc_id, nullif(trim(text, ' '), '') AS text, nullif(trim(source, ' '), '') AS source FROM (SELECT doc_id, text, source FROM documents UNION ALL SELECT * FROM (VALUES {_BLANKS}))")
def trim_blank_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM VALUES {_BLANKS} AS t(doc_id, text, source)")
    return ops.trim_blanks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").unionByName(dirty))


@plan(
    f"""WITH r AS (SELECT doc_id, text, source FROM documents UNION ALL SELECT * FROM (VALUES {_BLANKS}))
SELECT 'doc_id' AS variable, count(*) FILTER (doc_id IS NULL) AS n_missing FROM r
UNION ALL SELECT 'text', count(*) FILTER (text IS NULL OR trim(text, ' ') = '') FROM r
UNION ALL SELECT 'source', count(*) FILTER (source IS NULL OR trim(source, ' ') = '') FROM r"""
)
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM VALUES {_BLANKS} AS t(doc_id, text, source)")
    return ops.missing_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").unionByName(dirty))


_SPEAKERS = "(-1, 'PRESIDENTE', 'ROSSI MARIO. Grazie'), (-2, '', 'Anna Bianchi (PD). Signor'), (-3, NULL, 'niente'), (-4, 'Verdi', 'NERI LUCA. Si'), (-5, 'presidenza', ' DE LUCA ANNA, bene'), (-6, 'VICEPRESIDENTE', '')"
_CAP = ops.CAPITALS.replace("'", "''")
_CAPD = ops.CAPITALISED.replace("'", "''")


@plan(
    f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS speaker, text FROM documents UNION ALL SELECT * FROM (VALUES {_SPEAKERS})),
t AS (SELECT *, upper(coalesce(speaker, '')) IN ('', 'PRESIDENTE', 'PRESIDENZA', 'VICEPRESIDENTE', 'PRESIDENTE DELLA CAMERA') AS target,
  coalesce(nullif(regexp_extract(coalesce(text, ''), '{_CAP}', 1), ''), regexp_extract(coalesce(text, ''), '{_CAPD}', 1)) AS name FROM r),
i AS (SELECT *, CASE WHEN target THEN regexp_replace(name, '^\\s+|\\s+$', '', 'g') ELSE '' END AS inferred_name FROM t)
SELECT doc_id, inferred_name, CAST(target AND inferred_name <> '' AS INTEGER) AS inferred_flag, CASE WHEN target AND inferred_name <> '' THEN inferred_name ELSE speaker END AS speaker
FROM i WHERE coalesce(CASE WHEN target AND inferred_name <> '' THEN inferred_name ELSE speaker END, '') <> ''"""
)
def infer_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("speaker"), "text")
    rows = docs.unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, speaker, text FROM VALUES {_SPEAKERS} AS t(doc_id, speaker, text)"))
    return ops.infer_speakers(rows).select("doc_id", "inferred_name", "inferred_flag", "speaker")


_PARTIES = "(-1, 'Chair'), (-2, '#NAME?'), (-3, 'Others'), (-4, 'SVP–PATT'), (-5, '  Lega   Nord '), (-6, NULL), (-7, 'L''Ulivo')"
_PARTY_ROWS = f"r AS (SELECT doc_id, source AS party_name FROM documents UNION ALL SELECT * FROM (VALUES {_PARTIES}))"


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("party_name"))
    rows = _PARTIES.replace("''", "\\'")
    return docs.unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, party_name FROM VALUES {rows} AS t(doc_id, party_name)"))


@plan(f"WITH {_PARTY_ROWS} SELECT doc_id, party_name FROM r WHERE coalesce(party_name, '') NOT IN ('Chair', '#NAME?', 'Others')")
def party_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_parties(_parties(spark, sf_dir))


@plan(f"WITH {_PARTY_ROWS} SELECT doc_id, trim(regexp_replace(replace(party_name, '–', '-'), '\\s+', ' ', 'g'), ' ') AS party_name FROM r")
def party_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.normalize_party(_parties(spark, sf_dir))


_SIDES = [(f"src{n}", "Left" if n < 8 else "Right" if n < 16 else "Center", "Center-left" if n < 8 else "Center-right" if n < 16 else "Center") for n in range(18)] + list(ops.CROSSWALK)
_SIDES_SQL = "x(party_name, side3, side5) AS (VALUES " + ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in _SIDES) + ")"


def _sides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SIDES, "party_name string, side3 string, side5 string")


@plan(f"WITH {_PARTY_ROWS}, {_SIDES_SQL} SELECT coalesce(r.party_name, x.party_name) AS party_name, doc_id, side3, side5 FROM r FULL OUTER JOIN x ON r.party_name = x.party_name")
def side_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crosswalk(_parties(spark, sf_dir), _sides(spark))


@plan(f"WITH {_PARTY_ROWS}, {_SIDES_SQL} SELECT r.party_name, doc_id, side3, side5 FROM r LEFT JOIN x ON r.party_name = x.party_name")
def side_crosswalk_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.crosswalk(_parties(spark, sf_dir), _sides(spark), keep_unmatched=False)


_SIDE_ROWS = "(-1, 'Center'), (-2, 'M5S'), (-3, NULL), (-4, 'Left'), (-5, 'Mixed')"


def _side_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeches(spark, sf_dir).select("doc_id", "side3").unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, side3 FROM VALUES {_SIDE_ROWS} AS t(doc_id, side3)"))


_SIDE_CTE = f"{SPEECH}, r AS (SELECT doc_id, side3 FROM speech UNION ALL SELECT * FROM (VALUES {_SIDE_ROWS}))"


@plan(f"WITH {_SIDE_CTE} SELECT doc_id, CASE WHEN side3 IN ('Left', 'Right') THEN side3 WHEN side3 IN ('M5S', 'Center') THEN 'Other' ELSE '' END AS side FROM r")
def side_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side_rows(spark, sf_dir).select("doc_id", ops.side_of_report().alias("side"))


@plan(f"WITH {_SIDE_CTE} SELECT doc_id, side3, CASE WHEN side3 IN ('Center', 'M5S') THEN 'Center+M5S' ELSE side3 END AS bloc_combined FROM r")
def bloc_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _side_rows(spark, sf_dir).withColumn("bloc_combined", ops.combined_bloc())


@plan("SELECT doc_id, text, lang, source FROM documents")
def project_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.drop_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), prefixes=["n_"])


@plan("SELECT * FROM documents")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_parquet(spark, f"{sf_dir}/documents.parquet")


@plan("SELECT doc_id, text, lang FROM documents")
def first_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops columns by position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(docs.columns[:3])


@plan("SELECT doc_id, text, source FROM documents")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = readers.shared_path(spark, "scan-csv")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    readers.write_csv(docs, path, sep=";")
    return readers.read_csv(spark, path, "doc_id string, text string, source string").select(F.col("doc_id").try_cast("long").alias("doc_id"), "text", "source")


_MOJI = "(-1, 'perchÃ© la sanitÃ  Ã¨ piÃ¹'), (-2, NULL), (-3, 'cosÃ¬ perÃ²')"
_FIXED = "text"
for _wrong, _right in (("Ã¨", "è"), ("Ã ", "à"), ("Ã¹", "ù"), ("Ã²", "ò"), ("Ã¬", "ì"), ("Ã©", "é")):
    _FIXED = f"replace({_FIXED}, '{_wrong}', '{_right}')"


@plan(f"SELECT doc_id, {_FIXED} AS text FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_MOJI}))")
def mojibake_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM VALUES {_MOJI} AS t(doc_id, text)")).select("doc_id", fix_mojibake("text").alias("text"))


@plan(f"WITH {SPEECH} SELECT DISTINCT quarter, period, CAST(substr(quarter, 1, 4) AS INTEGER) AS year, CAST(substr(quarter, 6, 1) AS INTEGER) AS q FROM speech ORDER BY quarter LIMIT 20")
def period_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, q = year_and_quarter(F.col("quarter"))
    return speeches(spark, sf_dir).select("quarter", "period", y.alias("year"), q.alias("q")).distinct().orderBy("quarter").limit(20)


@plan(f"WITH {SPEECH} SELECT doc_id, period, lower(trim(coalesce(side3, ''), ' ')) AS side FROM speech")
def period_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeches(spark, sf_dir).select("doc_id", "period", F.lower(F.trim(F.coalesce("side3", F.lit("")))).alias("side"))


_YEARS = "(-1, 'a', '2019'), (-2, NULL, '2021'), (-3, 'b', NULL), (-4, 'c', '2020')"


@plan(f"WITH {SPEECH}, r AS (SELECT doc_id, text, CAST(year(d) AS VARCHAR) AS year FROM speech UNION ALL SELECT * FROM (VALUES {_YEARS})) SELECT doc_id, CAST(year AS INTEGER) AS year, CASE WHEN CAST(year AS INTEGER) >= 2020 THEN 'post' ELSE 'pre' END AS period FROM r WHERE text IS NOT NULL AND year IS NOT NULL")
def period_year_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speeches(spark, sf_dir).select("doc_id", "text", F.year("d").cast("string").alias("year"))
    s = s.unionByName(spark.sql(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, text, year FROM VALUES {_YEARS} AS t(doc_id, text, year)"))
    s = s.na.drop(subset=["text", "year"]).withColumn("year", F.col("year").try_cast("int"))
    return s.select("doc_id", "year", F.when(F.col("year") >= 2020, "post").otherwise("pre").alias("period"))


@plan(f"WITH {SPEECH} SELECT doc_id, quarter FROM speech WHERE quarter IS NULL OR quarter NOT IN ('2018q1', '2018q2')")
def quarter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeches(spark, sf_dir).filter(F.col("quarter").isNull() | ~F.col("quarter").isin("2018q1", "2018q2")).select("doc_id", "quarter")
