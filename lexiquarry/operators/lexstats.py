"""How vocabularies differ: counts, TF-IDF, log-odds, Jensen-Shannon distance, polarization.

All of these start from a long table of terms; the text is tokenised once and counted with map-side aggregation.
Divisions that can meet a zero give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """One row for each token: the kept columns and term."""
    return df.select(*keep, F.explode(tokens).alias("term"))


def term_counts(long: DataFrame, *by: str) -> DataFrame:
    """(by, term, n)."""
    return long.groupBy(*by, "term").agg(F.count("*").alias("n"))


def counted(tokens: Column) -> Column:
    """The distinct tokens of an array with their counts, array<struct<term, n>>: runs of the sorted array."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        of = lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("n")))
        return _let(starts, of)

    return F.when(F.size(tokens) > 0, _let(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<term:string,n:bigint>>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def document_tokens(df: DataFrame, tokens: Column, *by: str, doc: str = "doc_id") -> DataFrame:
    """(by, tokens), one row for each document, ``doc`` being one of ``by``.

    Where no id repeats (a count of ids tells), the table's own rows; else rows of an id are brought together as they are.
    """
    own = df.select(*by, tokens.alias("tokens"))
    if df.groupBy(doc).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return own
    return own.groupBy(*by).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))


def document_counts(df: DataFrame, tokens: Column, *by: str, doc: str = "doc_id") -> DataFrame:
    """(by, term, n) as ``term_counts`` of ``terms`` by documents, counted within their rows, without an exchange of tokens."""
    counts = document_tokens(df, tokens, *by, doc=doc).select(*by, counted(F.col("tokens")).alias("counts"))
    # an inner inline would be planned with a filter that counts every row's tokens once more
    return counts.select(*by, F.inline_outer("counts")).filter("n is not null")


def without(long: DataFrame, words: DataFrame) -> DataFrame:
    """Terms that aren't in words (term)."""
    return long.join(words, "term", "left_anti")


def vocabulary(long: DataFrame, n_docs: DataFrame, min_df: int = 5, max_df: float = 0.95, doc: str = "doc_id") -> DataFrame:
    """(term, n, df) of the terms in at least ``min_df`` documents and at most a share ``max_df`` of them.

    n_docs: one row (n_docs), the number of all documents.
    """
    per_doc = long.groupBy("term", doc).agg(F.count("*").alias("tf"))
    counts = per_doc.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    return counts.crossJoin(n_docs).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs"))).drop("n_docs")


def kept_terms(tf: DataFrame, n_docs: DataFrame, min_df: int = 5, max_df: float = 0.95, **more: Column) -> DataFrame:
    """As ``vocabulary``, of documents' counts (doc, term, n), with further sums over them."""
    counts = tf.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"), *(c.alias(k) for k, c in more.items()))
    return counts.crossJoin(n_docs).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs"))).drop("n_docs")


def count_documents(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_docs"))


def top(df: DataFrame, score: str, n: int, ascending: bool = False) -> DataFrame:
    """The n rows of largest score; ties by term."""
    return df.orderBy(F.col(score).asc() if ascending else F.col(score).desc(), "term").limit(n)


def tfidf_means(tf: DataFrame, kept: DataFrame, n_docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(term, tfidf_mean) of documents' counts (doc, term, n): n * (ln((1 + N) / (1 + df)) + 1), of unit length by document,
    averaged over all N documents.

    A document's weighted terms meet in one row, so that its length needs no further join; a term joins by its weight.
    """
    idf = kept.crossJoin(n_docs).select("term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(idf, "term").select(doc, "term", (F.col("n") * F.col("idf")).alias("w"))
    unit = weighted.groupBy(doc).agg(F.collect_list(F.struct("term", "w")).alias("ws"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    shares = unit.select("length", F.inline("ws")).groupBy("term").agg(F.sum(F.col("w") / F.col("length")).alias("share"))
    return shares.crossJoin(n_docs).select("term", (F.col("share") / F.col("n_docs")).alias("tfidf_mean"))


def two_sides(counts: DataFrame, side: str, a: str, b: str, *by: str) -> DataFrame:
    """(by, term, a, b): counts of two values of ``side`` in one aggregation; 0 where a side lacks the term."""
    pick = lambda v: F.sum(F.when(F.col(side) == v, F.col("n")).otherwise(0))
    return counts.filter(F.col(side).isin(a, b)).groupBy(*by, "term").agg(pick(a).alias("a"), pick(b).alias("b"))


def log_odds(sides: DataFrame, prior: float = 0.01, *by: str) -> DataFrame:
    """Adds log_odds of a against b and its z score to (by, term, a, b), over the terms of each group.

    Totals are small (one row for each group) and joined back, so that no group meets in one task.
    """
    a, b = F.col("a") + F.lit(prior), F.col("b") + F.lit(prior)
    total = sides.groupBy(*by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("v"))
    joined = sides.join(total, list(by)) if by else sides.crossJoin(total)
    pa, pb = a / (F.col("ta") + prior * F.col("v")), b / (F.col("tb") + prior * F.col("v"))
    odds = lambda p: F.ln(p / F.nullif(1 - p, F.lit(0.0)))
    lo = odds(pa) - odds(pb)
    return joined.withColumn("log_odds", lo).withColumn("z", F.col("log_odds") / F.sqrt(1 / a + 1 / b))


def polarization(counts: DataFrame, side: str = "side3", by: str = "quarter") -> DataFrame:
    """(by, polarization_score): mean absolute z of Left against Right; groups that lack a side go."""
    z = log_odds(two_sides(counts, side, "Left", "Right", by), 0.01, by)
    return z.filter("ta > 0 and tb > 0").groupBy(by).agg(F.avg(F.abs("z")).alias("polarization_score"))


def jensen_shannon(counts: DataFrame, side: str = "side3", by: str = "quarter") -> DataFrame:
    """(by, jsd, left_tokens, right_tokens): Jensen-Shannon distance to base 2; groups that lack a side go."""
    sides = two_sides(counts, side, "Left", "Right", by)
    total = sides.groupBy(by).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")).filter("ta > 0 and tb > 0")
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return sides.join(total, by).groupBy(by).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(part(p) + part(q)) / 2)).alias("jsd"), F.first("ta").alias("left_tokens"), F.first("tb").alias("right_tokens"))


def ranked(df: DataFrame, n: int, *by: str, score: str = "n", ascending: bool = False) -> DataFrame:
    """The n rows of largest score of each group with their rank; ties by term."""
    w = Window.partitionBy(*by).orderBy(F.col(score).asc() if ascending else F.col(score).desc(), "term")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def class_tfidf(counts: DataFrame, topic: str = "topic") -> DataFrame:
    """(topic, term, score): tf / sum of tf * ln(1 + A / f), A the mean number of words of a topic, f the term's count."""
    size = counts.groupBy(topic).agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("mean_size"))
    by_term = counts.groupBy("term").agg(F.collect_list(F.struct(topic, "n")).alias("ns"), F.sum("n").alias("f"))
    joined = by_term.select("term", "f", F.inline("ns")).join(size, topic).crossJoin(mean)
    return joined.select(topic, "term", "n", (F.col("n") / F.col("size") * F.ln(1 + F.col("mean_size") / F.col("f"))).alias("score"))
