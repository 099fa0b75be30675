"""Topics of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words, words
from ..operators import topics as ops
from ..operators.lexstats import document_counts, term_counts, terms
from ..operators.stopwords import HEALTH_PREFIXES, HEALTH_QUERY
from .catalog import SPEECH, T1, plan, speeches, tokens



def _counts(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    return term_counts(terms(speeches(spark, sf_dir), words("text"), *by), *by)


_CTFIDF = f"""{tokens(T1)}, c AS (SELECT topic, term, count(*) AS n FROM tok WHERE topic >= 0 GROUP BY ALL), size AS (SELECT topic, sum(n) AS size FROM c GROUP BY topic), f AS (SELECT term, sum(n) AS f FROM c GROUP BY term),
s AS (SELECT c.topic, c.term, n, round(n / size * ln(1 + (SELECT avg(size) FROM size) / f), 8) AS score FROM c JOIN size ON c.topic = size.topic JOIN f ON c.term = f.term),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM s)"""


def _top(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return ops.top_words(_counts(spark, sf_dir, "topic").filter("topic >= 0"), n)


@plan(f"WITH {_CTFIDF} SELECT topic, CAST(rank AS INTEGER) AS rank, term, score FROM r WHERE rank <= 10")
def ctfidf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, 10).select("topic", "rank", "term", "score")


_KEYS = "(" + " OR ".join(f"starts_with(strip_accents(lower(term)), '{p}')" for p in HEALTH_PREFIXES) + ")"


@plan(f"WITH {_CTFIDF} SELECT topic, bool_or({_KEYS}) AS by_keywords FROM r WHERE rank <= 20 GROUP BY topic")
def topic_keyword_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.keyword_topics(_top(spark, sf_dir, 20), HEALTH_PREFIXES)


_QUERY = ", ".join(f"'{w}'" for w in sorted(set(HEALTH_QUERY.split())))
_SETS = f"""{_CTFIDF}, kw AS (SELECT topic, bool_or({_KEYS}) AS by_keywords, string_agg(term, ', ' ORDER BY rank) FILTER (rank <= 10) AS top_words FROM r WHERE rank <= 20 GROUP BY topic),
sim AS (SELECT topic, round(count(*) FILTER (term IN ({_QUERY})) / sqrt(count(*) * {len(set(HEALTH_QUERY.split()))}.0), 6) AS similarity FROM r WHERE rank <= 10 GROUP BY topic),
sets AS (SELECT kw.topic, top_words, similarity, by_keywords, similarity >= (SELECT greatest(0.35, quantile_cont(similarity, 0.85)) FROM sim) AS by_semantic FROM kw JOIN sim ON kw.topic = sim.topic)"""


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with both kinds of flags: by the prefixes among 20 words, and by the similarity of 10 words with the query."""
    w = _top(spark, sf_dir, 20)
    ten = w.filter("rank <= 10")
    sem = ops.above_threshold(ops.phrase_similarity(ten, HEALTH_QUERY), "similarity")
    return ops.topic_phrases(ten).join(ops.keyword_topics(w, HEALTH_PREFIXES), "topic").join(sem, "topic")


@plan(f"WITH {_SETS} SELECT topic, by_keywords, by_semantic, by_keywords OR by_semantic AS in_union, by_keywords AND by_semantic AS in_intersection FROM sets")
def health_topic_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {"in_union": F.col("by_keywords") | F.col("by_semantic"), "in_intersection": F.col("by_keywords") & F.col("by_semantic")}
    return _sets(spark, sf_dir).select("topic", "by_keywords", "by_semantic", *[c.alias(n) for n, c in both.items()])


@plan(f"WITH {_SETS} SELECT topic, top_words, similarity, by_keywords, by_semantic FROM sets")
def topic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("topic", "top_words", "similarity", "by_keywords", "by_semantic")


@plan(
    f"""WITH {tokens(T1)}, c AS (SELECT topic, term, count(*) AS n FROM tok WHERE topic >= 0 GROUP BY ALL), size AS (SELECT topic, sum(n) AS size FROM c GROUP BY topic),
idf AS (SELECT term, ln(1 + (SELECT avg(size) FROM size) / sum(n)) AS idf FROM c GROUP BY term),
t AS (SELECT c.topic, c.term, n / size * idf AS w FROM c JOIN size ON c.topic = size.topic JOIN idf ON c.term = idf.term),
d AS (SELECT doc_id, tok.term, count(*) * any_value(idf) AS w FROM tok JOIN idf ON tok.term = idf.term WHERE topic = -1 GROUP BY ALL),
tn AS (SELECT topic, sqrt(sum(w * w)) AS n FROM t GROUP BY topic), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM d GROUP BY doc_id),
s AS (SELECT d.doc_id, t.topic, round(sum(d.w * t.w) / (any_value(dn.n) * any_value(tn.n)), 6) AS similarity FROM d JOIN t ON d.term = t.term JOIN dn ON d.doc_id = dn.doc_id JOIN tn ON t.topic = tn.topic GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, topic) AS k FROM s)
SELECT o.doc_id, -1 AS topic, CASE WHEN similarity >= 0.4 THEN b.topic ELSE -1 END AS new_topic, coalesce(similarity, 0) AS similarity FROM (SELECT DISTINCT doc_id FROM tok WHERE topic = -1) o LEFT JOIN b ON o.doc_id = b.doc_id AND k = 1"""
)
def ctfidf_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reassign_by_words(document_counts(speeches(spark, sf_dir), words("text"), "doc_id", "topic"))


@plan(f"WITH {SPEECH} SELECT count(*) AS n_docs, count(*) FILTER (topic = -1) AS n_outliers, round(avg(CAST(topic = -1 AS DOUBLE)), 6) AS outlier_rate FROM speech")
def outlier_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overview(speeches(spark, sf_dir))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeches(spark, sf_dir).select("doc_id", split_words("text").alias("tokens"))


_fits: dict[tuple, object] = {}


def _lda(spark: SparkSession, sf_dir: str, *ks: int) -> list:
    """The fits of a table, made once in a session; several share their counts."""
    t, keys = _tokens(spark, sf_dir), [(spark.sparkContext.applicationId, sf_dir, k) for k in ks or (20,)]
    missing = [key for key in keys if key not in _fits]
    if missing:
        counts = ops.count_words(t)
        for key in missing:
            _fits[key] = ops.fit_lda(t, key[2], counts=counts)
        counts.free()
    return [_fits[key] for key in keys]


@plan()
def lda_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the vocabulary and bound on the log perplexity of a fit of 20 topics."""
    (model,) = _lda(spark, sf_dir)
    return spark.createDataFrame([(20, len(model.stages[0].vocabulary), model.stages[1].log_perplexity(_tokens(spark, sf_dir)))], "k int, vocabulary int, log_perplexity double")


@plan()
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lda_topics(spark, *_lda(spark, sf_dir))


@plan()
def lda_doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lda_documents(*_lda(spark, sf_dir), _tokens(spark, sf_dir))


@plan()
def lda_health_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.flag_by_topics(ops.lda_documents(*_lda(spark, sf_dir), _tokens(spark, sf_dir)), (10, 11, 13))
    return got.select("doc_id", "p_health", "if_health")


@plan()
def lda_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean C_v coherence of the first 20 words of fits with 10 to 30 topics."""
    ks = range(10, 31, 5)
    words = [w for k, m in zip(ks, _lda(spark, sf_dir, *ks)) for w in ops.lda_words(spark, m, 20).withColumn("topic", F.col("topic") + 1000 * k).collect()]
    each = ops.cv_coherence(spark.createDataFrame(words, "topic int, rank int, term string"), _tokens(spark, sf_dir))
    found = each.groupBy(F.floor(F.col("topic") / 1000).cast("int").alias("k")).agg(F.avg("coherence").alias("coherence"))
    return spark.createDataFrame([(k,) for k in ks], "k int").join(found, "k", "left")


@plan()
def topic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fit_topics(ops.hashed_vectors(_tokens(spark, sf_dir)))


@plan()
def embed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return ops.hashed_vectors(_tokens(spark, sf_dir)).select("doc_id", vector_to_array("vector").alias("embedding"))
