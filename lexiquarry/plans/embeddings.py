"""Vectors of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import norm, unit
from ..operators import topics as ops
from ..operators.nearest import nearest
from .catalog import plan


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings; label is the topic, and every tenth vector an outlier."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.withColumn("topic", F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")).cast("int"))


_V = "v AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE CAST(label AS INTEGER) END AS topic, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)"
_LONG = f"{_V}, long AS (SELECT vec_id, topic, unnest(range(1, len(e) + 1)) AS i, unnest(e) / n AS x FROM u)"
_CENTRES = f"{_LONG}, m AS (SELECT topic, i, avg(x) AS x FROM long WHERE topic >= 0 GROUP BY ALL), c AS (SELECT topic, i, x / (sqrt(sum(x * x) OVER (PARTITION BY topic)) + 1e-12) AS x FROM m)"


@plan(f"WITH {_V} SELECT vec_id, doc_id, round(n, 6) AS norm, round(e[1] / n, 6) AS first FROM u JOIN documents ON vec_id = doc_id")
def embedding_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    v = _vectors(spark, sf_dir)
    return v.join(docs, F.col("vec_id") == F.col("doc_id")).select("vec_id", "doc_id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(unit(F.col("embedding"))[0], 6).alias("first"))


@plan(f"WITH {_CENTRES} SELECT topic, CAST(i - 1 AS INTEGER) AS i, round(x, 6) AS x FROM c")
def topic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.centroids(_vectors(spark, sf_dir)).select("topic", F.posexplode("centroid").alias("i", "x")).withColumn("x", F.round("x", 6))


@plan(
    f"""WITH {_CENTRES}, s AS (SELECT long.vec_id, c.topic, round(sum(long.x * c.x), 6) AS s FROM long JOIN c ON long.i = c.i WHERE long.topic = -1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic) AS k FROM s) SELECT vec_id, topic AS new_topic, s AS similarity FROM b WHERE k = 1"""
)
def centroid_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return ops.nearest_centroid(v.filter("topic = -1"), ops.centroids(v))


@plan(
    f"""WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.n * b.n), 6) AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every hundredth."""
    pairs = nearest(_vectors(spark, sf_dir), F.col("vec_id") % 100 == 0)
    return ops.by_rank(pairs, 5, "query_id", "cosine", "vec_id")


@plan(
    f"""WITH {_CENTRES}, q AS (SELECT i, x FROM long WHERE vec_id = 1), s AS (SELECT c.topic, round(sum(c.x * q.x), 6) AS similarity FROM c JOIN q ON c.i = q.i GROUP BY c.topic),
t AS (SELECT greatest(0.35, quantile_cont(similarity, 0.85)) AS threshold FROM s) SELECT topic, similarity, round(threshold, 6) AS threshold, similarity >= threshold AS by_semantic FROM s, t"""
)
def topic_semantic_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics near a query vector: at least 0.35 and the 85th percentile."""
    v = _vectors(spark, sf_dir)
    q = v.filter("vec_id = 1").select(unit(F.col("embedding")).alias("q"))
    sims = ops.centroids(v).crossJoin(q).select("topic", F.round(F.aggregate(F.zip_with("q", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6).alias("similarity"))
    return ops.above_threshold(sims, "similarity").select("topic", "similarity", F.round("threshold", 6).alias("threshold"), "by_semantic")


@plan(
    f"""WITH {_V}, ch AS (SELECT vec_id // 3 AS doc, CAST(vec_id % 3 AS INTEGER) AS position, CAST(100 + vec_id % 400 AS INTEGER) AS len, e FROM v),
w AS (SELECT *, greatest(greatest(len - 2, 1) - CASE WHEN position > 0 THEN least(128, greatest(len - 2, 1) - 1) ELSE 0 END, 1) AS w FROM ch),
l AS (SELECT doc, w, unnest(range(0, len(e))) AS i, unnest(e) AS x FROM w) SELECT doc, CAST(i AS INTEGER) AS i, round(sum(x * w) / sum(w), 6) AS x FROM l GROUP BY ALL"""
)
def weighted_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors each as the chunks of a document."""
    v = _vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("doc"), (F.col("vec_id") % 3).cast("int").alias("position"), (100 + F.col("vec_id") % 400).cast("int").alias("len"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return ops.pooled(v, "doc", "position", "len", "e").select("doc", F.posexplode("pooled").alias("i", "x")).withColumn("x", F.round("x", 6))
