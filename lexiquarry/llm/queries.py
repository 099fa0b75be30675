"""One thin query for each operator, over its whole table: it derives the digest columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import crc_mod, documents
from .decontaminate import decontaminate
from . import kneser_ney, oracles
from .embedding_dedup import embedding_dedup
from .html_extract import extract
from .language_id import identify, train
from .near_dedup import near_dedup
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts


def bpe_file() -> str:
    """The public byte-level vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(crc_mod(5) == 1, F.lit(False))
    model = kneser_ney.train(docs.filter(~held_out), 3)
    got = kneser_ney.score(docs.withColumn("held_out", held_out), model)
    return got.select("row.doc_id", "row.held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return got.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe(documents(spark, sf_dir), bpe_file())
    return got.select("row.doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = identify(docs, train(docs.filter(crc_mod(3) != 1)))
    held_out = F.coalesce(crc_mod(3, "row.doc_id") == 1, F.lit(False))
    return got.select("row.doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), bpe_file())


def op8_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return got.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op9_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_of", "kept")


QUERIES = {f.__name__: f for f in (op1_kneser_ney, op2_block_lstm, op3_bpe_automaton, op4_string_kernel, op5_suffix_array, op6_rabin_karp, op7_digest_cache, op8_prefix_join, op9_itq, op10_bagminhash)}
ORACLES: dict[str, str] = {
    "op5_suffix_array": oracles.BYTES,
    "op6_rabin_karp": oracles.SUBSTRINGS,
    "op8_prefix_join": oracles.BENCHMARK,
    "op9_itq": oracles.VECTORS,
    "op10_bagminhash": oracles.NEAR,
}
