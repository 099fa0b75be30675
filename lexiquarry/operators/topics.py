"""Topics: keyword and similarity rules, c-TF-IDF reassignment, LDA, and a clustering for fitted topics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import starts_with_any
from ..functions.vectors import unit
from . import lda
from .lexstats import class_tfidf, ranked


def top_words(counts: DataFrame, n: int = 10, topic: str = "topic") -> DataFrame:
    """(topic, rank, term, score) by c-TF-IDF."""
    return ranked(class_tfidf(counts, topic).withColumn("score", F.round("score", 8)), n, topic, score="score")


def topic_phrases(words: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, top_words): the ranked words in order, joined."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return words.groupBy(topic).agg(F.concat_ws(", ", F.transform(pairs, lambda p: p["term"])).alias("top_words"))


def keyword_topics(words: DataFrame, prefixes: Sequence[str], topic: str = "topic") -> DataFrame:
    """(topic, by_keywords): whether a top word, without accents, starts with one of the prefixes."""
    return words.groupBy(topic).agg(starts_with_any(F.collect_list("term"), prefixes).alias("by_keywords"))


def phrase_similarity(words: DataFrame, query: str, topic: str = "topic") -> DataFrame:
    """(topic, similarity): cosine of the words of a topic with those of the query, each word a dimension.

    Stands in for a sentence encoder; ``encoded_similarity`` takes one.
    """
    wanted = sorted(set(query.split()))
    common = F.count_if(F.col("term").isin(wanted))
    return words.groupBy(topic).agg(F.round(common / F.sqrt(F.count("*") * F.lit(float(len(wanted)))), 6).alias("similarity"))


def encoded_similarity(words: DataFrame, query: str, encoder, topic: str = "topic") -> DataFrame:
    """The same by a plugged-in ``encoder`` (list of texts to matrix): of the topic's words, in order, with the query."""

    def run(batches):
        import numpy as np
        import pandas as pd

        unit = lambda m: np.asarray(m, float) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        q = unit(encoder([query]))[0]
        for b in batches:
            yield pd.DataFrame({topic: b[topic], "similarity": unit(encoder(list(b["phrase"]))) @ q if len(b) else []})

    pairs = F.sort_array(F.collect_list(F.struct("rank", "term")))
    phrases = words.groupBy(topic).agg(F.concat_ws(" ", F.transform(pairs, lambda p: p["term"])).alias("phrase"))
    return phrases.mapInPandas(run, f"{topic} int, similarity double")


def above_threshold(scores: DataFrame, score: str, floor: float = 0.35, percentile: float = 0.85) -> DataFrame:
    """Adds by_semantic: the score reaches the larger of the floor and the percentile of all scores."""
    cut = scores.agg(F.greatest(F.lit(floor), F.percentile(score, F.lit(percentile))).alias("threshold"))
    return scores.crossJoin(cut).withColumn("by_semantic", F.col(score) >= F.col("threshold"))


def reassign_by_words(doc_counts: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_id, topic, new_topic, similarity) of outliers (topic -1; doc_id, topic, term, n).

    Each gets the topic of greatest cosine between c-TF-IDF vectors (ties: the least topic), or stays an outlier below
    ``least``. Documents are weighted by the terms' weights over all topics.
    """
    counts = doc_counts.filter("topic >= 0").groupBy("topic", "term").agg(F.sum("n").alias("n"))
    size = counts.groupBy("topic").agg(F.sum("n").alias("size"))
    idf = counts.groupBy("term").agg(F.sum("n").alias("f")).crossJoin(size.agg(F.avg("size").alias("m"))).select("term", F.ln(1 + F.col("m") / F.col("f")).alias("idf"))
    topics = counts.join(size, "topic").join(idf, "term").select("topic", "term", (F.col("n") / F.col("size") * F.col("idf")).alias("wt"))
    docs = doc_counts.filter("topic = -1").join(idf, "term").select("doc_id", "term", (F.col("n") * F.col("idf")).alias("wd"))
    length = lambda df, by, w: df.groupBy(by).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias(f"{w}_norm"))
    dots = docs.join(topics, "term").groupBy("doc_id", "topic").agg(F.sum(F.col("wd") * F.col("wt")).alias("dot"))
    sims = dots.join(length(docs, "doc_id", "wd"), "doc_id").join(length(topics, "topic", "wt"), "topic")
    sims = sims.withColumn("similarity", F.round(F.col("dot") / (F.col("wd_norm") * F.col("wt_norm")), 6))
    best = sims.groupBy("doc_id").agg(F.max(F.struct("similarity", (-F.col("topic")).alias("t"))).alias("best"))
    found = doc_counts.filter("topic = -1").select("doc_id", "topic").distinct().join(best, "doc_id", "left")
    similarity = F.coalesce("best.similarity", F.lit(0.0))
    return found.select("doc_id", "topic", F.when(similarity >= least, -F.col("best.t")).otherwise(F.lit(-1)).alias("new_topic"), similarity.alias("similarity"))


def centroids(vectors: DataFrame, topic: str = "topic", embedding: str = "embedding") -> DataFrame:
    """(topic, centroid): the mean unit vector of each topic, divided by its length + 1e-12."""
    long = vectors.filter(F.col(topic) >= 0).select(topic, F.posexplode(unit(F.col(embedding))).alias("i", "x"))
    mean = long.groupBy(topic, "i").agg(F.avg("x").alias("x"))
    c = mean.groupBy(topic).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))
    n = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    return c.withColumn("_n", n).select(topic, F.transform("c", lambda x: x / F.col("_n")).alias("centroid"))


def nearest_centroid(vectors: DataFrame, centres: DataFrame, key: str = "vec_id", topic: str = "topic", embedding: str = "embedding") -> DataFrame:
    """(key, new_topic, similarity) of vectors by cosine; ties go to the least topic.

    The centroids, one row for each topic, meet every vector; the best is kept in the aggregation, without a window.
    """
    u = vectors.select(key, unit(F.col(embedding)).alias("u"))
    sim = F.aggregate(F.zip_with("u", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pairs = u.crossJoin(centres.select(F.col(topic).alias("t"), "centroid")).select(key, "t", F.round(sim, 6).alias("s"))
    best = pairs.groupBy(key).agg(F.max(F.struct("s", (-F.col("t")).alias("neg"))).alias("best"))
    return best.select(key, (-F.col("best.neg")).alias("new_topic"), F.col("best.s").alias("similarity"))


def count_words(tokens: DataFrame, min_df: int = 10, max_df: float = 0.5, words: int = 100_000) -> lda.Counted:
    """The counts that fits of ``tokens`` with any number of topics share; ``free`` them after these."""
    return lda.counted(tokens, min_df, max_df, words)


def fit_lda(tokens: DataFrame, k: int = 20, passes: int = 10, seed: int = 42, counts: lda.Counted | None = None) -> lda.Fit:
    """Counts and online LDA with symmetric priors 1/k over (doc_id, tokens); each pass reads every document once."""
    mine = counts or count_words(tokens)
    try:
        return lda.fit(mine, k, passes, seed)
    finally:
        if counts is None:
            mine.free()


def lda_topics(spark: SparkSession, model: lda.Fit, n: int = 10) -> DataFrame:
    """(topic, top_words)."""
    return topic_phrases(lda_words(spark, model, n))


def lda_words(spark: SparkSession, model: lda.Fit, n: int = 10) -> DataFrame:
    """(topic, rank, term)."""
    return spark.createDataFrame(model.stages[1].top(n), "topic int, rank int, term string")


def lda_documents(model: lda.Fit, tokens: DataFrame) -> DataFrame:
    """(doc_id, topic_0 .., topic, p_max): distributions over topics and the likeliest.

    A document without a word of the vocabulary has the prior, 1/k for each topic, and no likeliest one (null).
    """
    k = model.stages[1].getK()
    p = model.stages[1].shares(tokens)
    empty = F.array_max("p") <= 0
    p = p.select("doc_id", F.when(empty, F.array_repeat(F.lit(1.0 / k), k)).otherwise(F.col("p")).alias("p"), empty.alias("empty"))
    best = F.array_max("p")
    topic = F.when(~F.col("empty"), F.array_position("p", best) - 1).cast("int")
    return p.select("doc_id", *[F.col("p")[i].alias(f"topic_{i}") for i in range(k)], topic.alias("topic"), best.alias("p_max"))


def flag_by_topics(documents: DataFrame, topics: Sequence[int], least: float = 0.3) -> DataFrame:
    """Adds p_health, the summed shares of the topics, and if_health (at least ``least``). Topic ids belong to a fit."""
    total: Column = sum((F.col(f"topic_{t}") for t in topics), F.lit(0.0))
    return documents.withColumn("p_health", total).withColumn("if_health", F.col("p_health") >= least)


def cv_coherence(words: DataFrame, tokens: DataFrame, window: int = 110) -> DataFrame:
    """(topic, coherence) of (topic, rank, term) in (doc_id, tokens): C_v coherence (Röder, Both and Hinneburg 2015).

    Windows of ``window`` tokens slide over each document (a shorter one is one window); words and pairs of words of a
    topic are counted by the windows that have them. A word's vector has its normalised pointwise mutual information with
    each word of the topic; a topic's coherence is the mean cosine of these vectors with their sum.
    """
    size = F.size("tokens")
    n = tokens.agg(F.sum(F.greatest(size - window + 1, F.lit(1))).alias("n"))
    together = _in_windows(words, tokens, window).groupBy("a", "b").agg(F.sum("m").alias("m"))
    single = together.filter("a = b").select(F.col("a").alias("term"), F.col("m").alias("d"))
    a, b = (words.select("topic", F.col("term").alias(x)).join(single.select(F.col("term").alias(x), F.col("d").alias(f"n{x}")), x, "left") for x in "xy")
    grid = a.join(b, "topic").withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).join(together, ["a", "b"], "left").crossJoin(n)
    p, tiny = F.coalesce("m", F.lit(0)) / F.col("n"), 1e-12
    npmi = F.ln((p + tiny) / (F.col("nx") / F.col("n") * F.col("ny") / F.col("n"))) / -F.ln(p + tiny)
    grid = grid.select("topic", "x", "y", F.coalesce(npmi, F.lit(0.0)).alias("v"))
    total = grid.groupBy("topic", "y").agg(F.sum("v").alias("t"))
    cosine = F.sum(F.col("v") * F.col("t")) / F.nullif(F.sqrt(F.sum(F.col("v") ** 2)) * F.sqrt(F.sum(F.col("t") ** 2)), F.lit(0.0))
    return grid.join(total, ["topic", "y"]).groupBy("topic", "x").agg(F.coalesce(cosine, F.lit(0.0)).alias("c")).groupBy("topic").agg(F.avg("c").alias("coherence"))


def _in_windows(words: DataFrame, tokens: DataFrame, window: int) -> DataFrame:
    """(a, b, m): windows with both words, of the pairs a <= b of a topic's words, once for each task."""
    listed = words.select("topic", "term").distinct().collect()
    terms = sorted({r.term for r in listed if r.term is not None})
    at, mine = {t: i for i, t in enumerate(terms)}, {}
    for r in listed:
        if r.term is not None:
            mine.setdefault(r.topic, []).append(at[r.term])
    pairs = np.array(sorted({(i, j) for w in mine.values() for i in w for j in w if terms[i] <= terms[j]}), np.int64).reshape(-1, 2)

    def run(batches):
        known, total = pa.array(terms, pa.string()), np.zeros((len(terms), len(terms)))
        for b in batches:
            lists = b.column(0)
            word = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy()
            start = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            for d in range(len(lists)):
                doc = word[start[d] : start[d + 1]]
                for s in range(0, max(1, len(doc) - window + 1), 4096):  # some windows at a time
                    part = doc[s : s + 4096 + window - 1]
                    found = np.flatnonzero(part >= 0)
                    if not len(found):
                        continue
                    held, column = np.unique(part[found], return_inverse=True)
                    seen = np.zeros((len(part) + 1, len(held)), np.int32)
                    seen[found + 1, column] = 1
                    seen = seen.cumsum(0, dtype=np.int32)
                    most = max(1, len(part) - window + 1)
                    has = (seen[len(part) - most + 1 :] > seen[:most]).astype(np.float32)
                    total[np.ix_(held, held)] += has.T @ has
        m = total[pairs[:, 0], pairs[:, 1]].astype(np.int64)
        some = m > 0
        names = pa.array(terms, pa.string())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(pairs[some, 0])), names.take(pa.array(pairs[some, 1])), pa.array(m[some])], ["a", "b", "m"])

    return tokens.select("tokens").mapInArrow(run, "a string, b string, m long")


def umass_coherence(words: DataFrame, doc_terms: DataFrame) -> DataFrame:
    """(topic, coherence): mean over word pairs of ln((D(w, v) + 1) / D(v)) of (topic, rank, term) in (doc_id, term)."""
    mine = doc_terms.join(words.select("term").distinct(), "term", "left_semi")
    df = mine.groupBy("term").agg(F.count("*").alias("d"))
    a, b = (words.select("topic", F.col("rank").alias(f"r{x}"), F.col("term").alias(x)) for x in "ab")
    pairs = a.join(b, "topic").filter("ra > rb")
    wanted = pairs.select("a", "b").distinct()
    together = wanted.join(mine.select(F.col("term").alias("a"), "doc_id"), "a").join(mine.select(F.col("term").alias("b"), "doc_id"), ["b", "doc_id"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    scored = pairs.join(together, ["a", "b"], "left").join(df.select(F.col("term").alias("b"), "d"), "b")
    return scored.groupBy("topic").agg(F.avg(F.ln((F.coalesce("n", F.lit(0)) + 1) / F.col("d"))).alias("coherence"))


def fit_topics(docs: DataFrame, k: int = 10, dims: int = 5, least: int = 20, far: float = 2.0, seed: int = 42, vector: str = "vector") -> DataFrame:
    """(doc_id, topic, is_outlier): unit vectors, PCA, k-means; clusters of fewer than ``least`` documents are outliers (-1).

    So are documents further from their cluster's centre than ``far`` times its root mean square distance. Stands in for
    density clustering after a neighbour embedding, for which Spark has no operator.

    ``docs`` is computed once for the fit, which keeps the unit vectors on disk until its end, and once, row by row, for
    the result.
    """
    normal = Normalizer(inputCol=vector, outputCol="_u")
    units = normal.transform(docs).select("_u").persist(StorageLevel.DISK_ONLY)
    try:
        pca = PCA(k=dims, inputCol="_u", outputCol="_p").fit(units)
        means = KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="_c").fit(pca.transform(units).select("_p"))
        centres = docs.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(means.clusterCenters())], "_c int, _m array<double>")

        def placed(vectors: DataFrame, *keep: str) -> DataFrame:
            found = means.transform(pca.transform(vectors)).select(*keep, "_c", vector_to_array("_p").alias("_x")).join(F.broadcast(centres), "_c")
            return found.select(*keep, "_c", F.aggregate(F.zip_with("_x", "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("_d"))

        sizes = placed(units).groupBy("_c").agg(F.count("*").alias("_n"), F.avg("_d").alias("_r")).collect()
    finally:
        units.unpersist()
    size = docs.sparkSession.createDataFrame(sizes, "_c int, _n long, _r double")
    topic = F.when((F.col("_n") < least) | (F.col("_d") > far * far * F.col("_r")), F.lit(-1)).otherwise(F.col("_c"))
    return placed(normal.transform(docs), "doc_id").join(F.broadcast(size), "_c").select("doc_id", topic.alias("topic"), (topic == -1).alias("is_outlier"))


def hashed_vectors(docs: DataFrame, size: int = 256) -> DataFrame:
    """(doc_id, vector): the default encoder, hashed token counts of unit length, where no neural one is plugged in."""
    raw = HashingTF(inputCol="tokens", outputCol="_raw", numFeatures=size).transform(docs)
    return Normalizer(inputCol="_raw", outputCol="vector").transform(raw).select("doc_id", "vector")


def embed(docs: DataFrame, encoder, text: str = "text") -> DataFrame:
    """(doc_id, vector) by a plugged-in ``encoder`` (list of texts to matrix), called by batch in pandas functions."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "values": [list(map(float, v)) for v in encoder(["passage: " + t for t in b[text].fillna("")])]})

    return docs.select("doc_id", text).mapInPandas(run, "doc_id long, values array<double>").select("doc_id", array_to_vector("values").alias("vector"))


def pooled(chunks: DataFrame, key: str, position: str, length: str, vector: str, overlap: int = 128) -> DataFrame:
    """(key, pooled): chunk vectors averaged with the weight of the tokens that they don't share with the chunk before."""
    c = F.greatest(F.col(length) - 2, F.lit(1))
    o = F.when(F.col(position) > 0, F.least(F.lit(overlap), c - 1)).otherwise(F.lit(0))
    w = F.greatest(c - o, F.lit(1)).alias("w")
    long = chunks.select(key, w, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(key, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    return mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("pooled"))


def overview(df: DataFrame, topic: str = "topic") -> DataFrame:
    """(n_docs, n_outliers, outlier_rate)."""
    out = (F.col(topic) == -1).cast("double")
    return df.agg(F.count("*").alias("n_docs"), F.sum(out).cast("long").alias("n_outliers"), F.round(F.avg(out), 6).alias("outlier_rate"))


def by_rank(df: DataFrame, n: int, by: str, score: str, tie: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
