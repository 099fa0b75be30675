"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Rows with equal or null doc_ids are documents of their
own, told apart by an order of doc_id and text; a null text is an empty one. Rows travel as one struct, so no column of
documents clashes with a stage's own. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.llm.bpe import bpe
from lexiquarry.llm.common import crc_mod, documents, keyed, staged
from lexiquarry.llm.decontaminate import decontaminate
from lexiquarry.llm.language_id import UNDETERMINED, identify, train
from lexiquarry.llm.near_dedup import near_dedup
from lexiquarry.llm.queries import bpe_file
from lexiquarry.llm.suffix_dedup import suffix_dedup

#: A text is in a known language if its best share is so many times the share of each language without any evidence.
LEAST_SHARE = 1.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without letters (or null) or like none of the languages go.

    Equal texts have equal fates; equal shares go to the first language in order.
    """
    model = train(docs.filter(crc_mod(3) != 1))
    least = LEAST_SHARE / len(model.classes) if model and len(model.classes) > 1 else 0.0
    return identify(docs, model).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group, by doc_id (null first) and text; texts without words are in no group."""
    rows = keyed(docs)
    kept = near_dedup(rows.select("doc_id", "text")).filter("kept").select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes and more that occur earlier; documents of which nothing is left go.

    A character that a cut splits goes as a whole. ``n_chars`` follows the text; untouched rows stay as they are.
    """
    rows = keyed(docs)
    cut = suffix_dedup(rows.select("doc_id", "text"), as_text=True).select("doc_id", "n_removed", "kept")
    got = rows.select("doc_id", "row").join(cut, "doc_id").filter((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return got.select(*(F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without windows of benchmark items; null and empty texts have none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter(~F.col("contaminated")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left: ids and the text decoded from them, as digests; a row for each row."""
    got = bpe(docs, bpe_file())
    return got.select("row.doc_id", "row.lang", "row.source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("BPE encoding and decoding", tokens),
]

#: Trained scores, signatures and BPE merges aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline{k}")
    return docs
