"""Token counts through a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens) in the shared folder. Texts are digested, joined to
the counts that are stored for this version of the tokenizer, and only the distinct contents that miss are encoded;
their counts are appended to the cache. Normalisation must not change counts, so it is only null to empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, new_path, staged, texts, tune

CACHE = "content binary, tokenizer string, n_tokens long"


def version(path: str) -> str:
    """Digest of a tokenizer's file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + library.encode()).hexdigest()


@lru_cache(2)
def counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda values: [len(x) for x in p.encode(values, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda values: [len(t.encode(v, add_special_tokens=False)) for v in values]


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512, text: str = "text") -> DataFrame:
    """Counts the tokens of each whole text with the tokenizer file at ``path`` (on every machine).

    ``cache`` is the folder of the cache table, kept between calls; without one, a new one in the shared folder is
    used. Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``), a row for each row.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and texts each get a row; ids aren't used, so null or
    repeated ones need no rule. An empty table gives no rows and leaves the cache as it is.
    """
    spark = docs.sparkSession
    tune(spark)
    cache = cache or new_path(spark, "token-cache")
    v = version(path)
    digested = texts(docs, text).withColumn("content", F.unhex(F.sha2("text", 256)))
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == v)
    misses = digested.groupBy("content").agg(F.first("text").alias("text")).join(known, "content", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            n = count(b.column("text").to_pylist())
            yield pa.record_batch({"content": b.column("content"), "tokenizer": pa.array([v] * len(n)), "n_tokens": pa.array(n, pa.int64())})

    misses.select("content", "text").mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == v).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    got = join_unique(staged(digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "digests"), counts, "content")
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
