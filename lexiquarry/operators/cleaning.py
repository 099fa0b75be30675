"""Cleaning of raw speech rows: blanks, dates, speakers, parties, sides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.periods import day_first
from ..functions.text import collapse_spaces, trim_unicode

#: What stands in for a speaker's name, upper-cased; party names to drop; party, side of three and of five.
GENERIC_SPEAKERS = ("", "PRESIDENTE", "PRESIDENZA", "VICEPRESIDENTE", "PRESIDENTE DELLA CAMERA")
DROPPED_PARTIES = ("Chair", "#NAME?", "Others")
CROSSWALK = (
    ("#NAME?", "Left", "Left"),
    ("Associativo Italiani all'Estero", "Center", "Center"),
    ("Centro Democratico", "Center", "Center"),
    ("Centrodestra", "Right", "Center-right"),
    ("Centrosinistra", "Left", "Center-left"),
    ("Chair", "", "Other"),
    ("Forza Italia - Il Popolo della Libertà", "Right", "Center-right"),
    ("Fratelli d'Italia", "Right", "Right"),
    ("Italia dei Valori", "Center", "Center-left"),
    ("L'Ulivo", "Left", "Center-left"),
    ("Lega", "Right", "Right"),
    ("Lega Nord", "Right", "Right"),
    ("MAIE", "Center", "Center"),
    ("Movimento 5 Stelle", "M5S", "M5S"),
    ("Others", "", "Other"),
    ("Partito Democratico", "Left", "Center-left"),
    ("Partito Popolare Italiano", "Center", "Center"),
    ("Radicali", "Center", "Center-left"),
    ("SVP-PATT", "Center", "Center"),
    ("Scelta Civica", "Center", "Center"),
    ("Sinistra Ecologia Libertà", "Left", "Left"),
    ("Südtiroler Volkspartei", "Center", "Center"),
    ("USEI", "Center", "Center"),
    ("Union Valdôtaine", "Center", "Center"),
    ("Unione / Centro", "Center", "Center"),
)
#: A name in capitals followed by a full stop or comma; a capitalised name followed by a bracket.
CAPITALS = r"(?s)^\s*([A-ZÀ-Ü'\-\.]+(?:\s+[A-ZÀ-Ü'\-]+){1,3})\s*[.,]"
CAPITALISED = r"(?s)^\s*([A-Z][A-Za-zÀ-ÿ'\-\.]+(?:\s+[A-Z][A-Za-zÀ-ÿ'\-\.]+){1,3})\s*\("


def trim_blanks(df: DataFrame) -> DataFrame:
    """Every string column without blanks (0x20) at its ends; nothing left is null."""
    return df.select(*[F.nullif(F.trim(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def missing_counts(df: DataFrame) -> DataFrame:
    """(variable, n_missing) of each column in one pass; blank strings count as missing."""
    blank = lambda f: F.col(f.name).isNull() | (F.trim(f.name) == "" if isinstance(f.dataType, T.StringType) else F.lit(False))
    one = df.agg(*[F.count_if(blank(f)).alias(f.name) for f in df.schema])
    return one.unpivot([], list(df.columns), "variable", "n_missing")


def dated(df: DataFrame, date: str = "date", after: str = "2017-12-31") -> DataFrame:
    """Rows with a day-first date later than ``after``, with d and year; blank and bad dates go."""
    return df.withColumn("d", day_first(F.col(date))).filter(F.col("d") > F.lit(after).cast("date")).withColumn("year", F.year("d"))


def infer_speakers(df: DataFrame) -> DataFrame:
    """Fills generic speakers from the beginning of the text; rows still without a speaker go.

    Adds inferred_name (empty: none) and inferred_flag (1 and 0 for generic speakers, 0 for others).
    """
    target = F.upper(F.coalesce("speaker", F.lit(""))).isin(*GENERIC_SPEAKERS)
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.nullif(F.regexp_extract(text, CAPITALS, 1), F.lit("")), F.regexp_extract(text, CAPITALISED, 1))
    out = df.withColumn("_target", target).withColumn("inferred_name", F.when(F.col("_target"), trim_unicode(name)).otherwise(""))
    out = out.withColumn("inferred_flag", (F.col("_target") & (F.col("inferred_name") != "")).cast("int"))
    out = out.withColumn("speaker", F.when(F.col("inferred_flag") == 1, F.col("inferred_name")).otherwise(F.col("speaker")))
    return out.filter(F.coalesce("speaker", F.lit("")) != "").drop("_target")


def drop_parties(df: DataFrame) -> DataFrame:
    """Without chairs, the mixed group and others; rows without a party stay."""
    return df.filter(~F.coalesce("party_name", F.lit("")).isin(*DROPPED_PARTIES))


def normalize_party(df: DataFrame) -> DataFrame:
    """Party names with hyphens for dashes and single spaces."""
    return df.withColumn("party_name", collapse_spaces(F.translate("party_name", "–", "-")))


def crosswalk(df: DataFrame, sides: DataFrame, keep_unmatched: bool = True) -> DataFrame:
    """Joins (party_name, side3, side5), unique by party_name, to the rows.

    With ``keep_unmatched`` as a full join: sides without rows are appended. Else the rows only, with the small side
    broadcast by its own size.
    """
    return df.join(sides, "party_name", "full" if keep_unmatched else "left")


def side_of_report(side3: str = "side3"):
    """Left, Right or Other (Center, M5S); blank otherwise."""
    c = F.col(side3)
    return F.when(c.isin("Left", "Right"), c).when(c.isin("M5S", "Center"), "Other").otherwise("")


def combined_bloc(side3: str = "side3"):
    c = F.col(side3)
    return F.when(c.isin("Center", "M5S"), "Center+M5S").otherwise(c)


def drop_columns(df: DataFrame, names: Iterable[str] = (), prefixes: Iterable[str] = ()) -> DataFrame:
    """Without columns of these names or with these prefixes."""
    prefixes = tuple(prefixes)
    return df.drop(*names, *[c for c in df.columns if prefixes and c.startswith(prefixes)])


def text_column(df: DataFrame) -> str:
    """The first of text_clean, text and speech that the rows have."""
    for c in ("text_clean", "text", "speech"):
        if c in df.columns:
            return c
    raise ValueError("no text column: expected text_clean, text or speech")
