"""Tokens, vocabularies and lexical differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import latin_words, ngrams as ngrams_of, overlapping_chunks, split_words, words
from ..operators import lexstats as ops
from ..operators import resample
from ..operators.stopwords import DOMAIN_WORDS, italian_stop_words
from .catalog import SPEECH, T1, T2, T3, log_odds_cte, plan, speeches, tokens

#: The Italian stop words, and frequent ones of the languages in the test tables.
STOPS = sorted({*italian_stop_words(), "the", "and", "for", "that", "und", "der", "die", "les", "des", "que", "los", "las"})
_list = lambda ws: ", ".join("('" + w.replace("'", "''") + "')" for w in ws)
_STOP = f"stops(term) AS (VALUES {_list(STOPS)})"
_DOMAIN = f"domain(term) AS (VALUES {_list(DOMAIN_WORDS)})"


def _words(spark: SparkSession, terms: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")


def _long(spark: SparkSession, sf_dir: str, kind=words) -> DataFrame:
    return ops.terms(speeches(spark, sf_dir), kind("text"), "doc_id", "quarter", "side3", "period", "topic")


def _by_doc(kind: str) -> str:
    return f"WITH {tokens(kind)} SELECT doc_id, term, count(*) AS n FROM tok GROUP BY ALL"


@plan(_by_doc(T1))
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.document_counts(speeches(spark, sf_dir), words("text"), "doc_id")


@plan(_by_doc(T2))
def tokenize_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.document_counts(speeches(spark, sf_dir), latin_words("text"), "doc_id")


@plan(_by_doc(T3))
def tokenize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.document_counts(speeches(spark, sf_dir), split_words("text"), "doc_id")


@plan(f"WITH {tokens(T1)} SELECT side3, period, term, count(*) AS n FROM tok WHERE side3 IS NOT NULL GROUP BY ALL")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.term_counts(_long(spark, sf_dir).filter("side3 is not null"), "side3", "period")


@plan(f"WITH {tokens(T3)} SELECT DISTINCT term FROM tok ORDER BY term")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir, split_words).select("term").distinct().orderBy("term")


@plan(
    f"""WITH {SPEECH}, w AS (SELECT doc_id, {T1} AS t FROM speech),
g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS gram FROM w)
SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL"""
)
def ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.document_counts(speeches(spark, sf_dir), ngrams_of(words("text"), 1, 2), "doc_id").withColumnRenamed("term", "gram")


@plan(
    f"""WITH {SPEECH}, w AS (SELECT doc_id, {T3} AS t FROM speech),
c AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - 510) / 382.0)) AS BIGINT) + 1)) AS k FROM w)
SELECT doc_id, CAST(k AS INTEGER) AS position, CAST(len(t[k * 382 + 1 : k * 382 + 510]) AS INTEGER) AS n_tokens, md5(array_to_string(t[k * 382 + 1 : k * 382 + 510], ' ')) AS digest FROM c"""
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = speeches(spark, sf_dir).select("doc_id", F.posexplode(overlapping_chunks(split_words("text"))).alias("position", "chunk"))
    return chunks.select("doc_id", "position", F.size("chunk").alias("n_tokens"), F.md5(F.concat_ws(" ", "chunk").cast("binary")).alias("digest"))


@plan(f"WITH {tokens(T1)}, {_STOP} SELECT doc_id, term, count(*) AS n FROM tok WHERE term NOT IN (SELECT term FROM stops) GROUP BY ALL")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.without(ops.document_counts(speeches(spark, sf_dir), words("text"), "doc_id"), F.broadcast(_words(spark, STOPS)))


@plan(f"WITH {SPEECH} SELECT doc_id, array_to_string(list_filter({T1.replace('> 2', '> 1')}, lambda t: regexp_full_match(t, '\\p{{L}}+') AND NOT list_contains([{', '.join(repr(w) for w in STOPS)}], t)), ' ') AS text_repro FROM speech")
def reprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(words("text", 2), lambda t: ~t.isin(STOPS) & t.rlike(r"^\p{L}+$"))
    return speeches(spark, sf_dir).select("doc_id", F.concat_ws(" ", kept).alias("text_repro"))


@plan(
    f"""WITH {tokens(T1)}, {_DOMAIN}, counts AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
common AS ((SELECT term FROM counts ORDER BY n DESC, term LIMIT 200) UNION SELECT term FROM domain)
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (term NOT IN (SELECT term FROM common)) AS n_left FROM tok GROUP BY doc_id"""
)
def common_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    common = ops.top(ops.term_counts(long), "n", 200).select("term").union(_words(spark, DOMAIN_WORDS)).distinct()
    per = ops.term_counts(long, "doc_id").join(common.withColumn("common", F.lit(True)), "term", "left")
    return per.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("common"), 0).otherwise(F.col("n"))).alias("n_left"))


@plan(
    f"""WITH {tokens(T3)}, c AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term)
SELECT term, df, cf FROM c WHERE df >= 10 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 100000"""
)
def dictionary_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ops.count_documents(speeches(spark, sf_dir))
    kept = ops.kept_terms(ops.document_counts(speeches(spark, sf_dir), split_words("text"), "doc_id"), n, 10, 0.5)
    return kept.orderBy(F.desc("df"), "term").limit(100_000).select("term", "df", F.col("n").alias("cf"))


@plan(
    f"""WITH {tokens(T3)}, c AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term),
kept AS (SELECT term FROM c WHERE df >= 10 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 100000)
SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM kept) GROUP BY ALL"""
)
def doc_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    tf = ops.document_counts(speeches(spark, sf_dir), split_words("text"), "doc_id").withColumnRenamed("n", "tf")
    return tf.join(dictionary_extremes(spark, sf_dir).select("term"), "term", "left_semi").select("doc_id", "term", "tf")


def _bounded(condition: str = "TRUE") -> str:
    return f"""{tokens(T2)}, {_STOP}, mine AS (SELECT * FROM tok WHERE {condition} AND term NOT IN (SELECT term FROM stops)),
nd AS (SELECT count(*) AS n_docs FROM speech WHERE {condition}),
kept AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM mine GROUP BY term HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.95 * (SELECT n_docs FROM nd))"""


def _kept(spark: SparkSession, sf_dir: str, condition: str = "true") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, side3, period, term, n), the terms that are neither rare nor common, and the number of documents."""
    s = speeches(spark, sf_dir).filter(condition)
    n = ops.count_documents(s)
    tf = ops.without(ops.document_counts(s, latin_words("text"), "doc_id", "side3", "period"), F.broadcast(_words(spark, STOPS)))
    return tf, ops.kept_terms(tf, n), n


@plan(f"WITH {_bounded()} SELECT term, n AS count FROM kept ORDER BY n DESC, term LIMIT 30")
def top_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top(_kept(spark, sf_dir)[1], "n", 30).select("term", F.col("n").alias("count"))


@plan(f"WITH {_bounded()} SELECT term, n AS count FROM kept ORDER BY n DESC, term LIMIT 200")
def wordcloud_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top(_kept(spark, sf_dir)[1], "n", 200).select("term", F.col("n").alias("count"))


def _tfidf(condition: str = "TRUE", n: int = 30) -> str:
    return f"""{_bounded(condition)}, tf AS (SELECT doc_id, term, count(*) AS tf FROM mine WHERE term IN (SELECT term FROM kept) GROUP BY ALL),
w AS (SELECT doc_id, tf.term, tf * (ln((1 + n_docs) / (1 + df)) + 1) AS w, n_docs FROM tf JOIN kept ON tf.term = kept.term CROSS JOIN nd),
u AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u, n_docs FROM w),
mean AS (SELECT term, sum(u) / any_value(n_docs) AS m FROM u GROUP BY term)"""


@plan(f"WITH {_tfidf()} SELECT term, round(m, 6) AS tfidf_mean FROM mean ORDER BY round(m, 6) DESC, term LIMIT 30")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.tfidf_means(*_kept(spark, sf_dir)).withColumn("tfidf_mean", F.round("tfidf_mean", 6))
    return ops.top(got, "tfidf_mean", 30)


_PERIODS = "sides AS (SELECT term, count(*) FILTER (period = 'pre') AS a, count(*) FILTER (period = 'post') AS b FROM mine WHERE term IN (SELECT term FROM kept) GROUP BY term)"


def _periods(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    tf, _, n = _kept(spark, sf_dir, condition)
    pick = lambda v: F.sum(F.when(F.col("period") == v, F.col("n")).otherwise(0))
    return ops.kept_terms(tf, n, a=pick("pre"), b=pick("post")).select("term", "a", "b")


@plan(f"WITH {_bounded()}, {_PERIODS}, {log_odds_cte('sides')} SELECT term, round(log_odds, 6) AS log_odds FROM z")
def logodds_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.log_odds(_periods(spark, sf_dir)).select("term", F.round("log_odds", 6).alias("log_odds"))


_DISTINCT = """(SELECT 'pre' AS side, term, round(-log_odds, 6) AS log_odds FROM z WHERE log_odds > 0 ORDER BY round(-log_odds, 6), term LIMIT 30)
UNION ALL (SELECT 'post', term, round(-log_odds, 6) FROM z WHERE log_odds < 0 ORDER BY round(-log_odds, 6) DESC, term LIMIT 30)"""


def _distinctive(sides: DataFrame, n: int = 30, a: str = "pre", b: str = "post") -> DataFrame:
    got = ops.log_odds(sides, 1.0).select("term", (-F.col("log_odds")).alias("raw"), F.round(-F.col("log_odds"), 6).alias("log_odds"))
    first = ops.top(got.filter("raw < 0"), "log_odds", n, ascending=True).select(F.lit(a).alias("side"), "term", "log_odds")
    return first.unionByName(ops.top(got.filter("raw > 0"), "log_odds", n).select(F.lit(b).alias("side"), "term", "log_odds"))


@plan(f"WITH {_bounded()}, {_PERIODS}, {log_odds_cte('sides', '', '1.0')} {_DISTINCT}")
def distinctive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinctive(_periods(spark, sf_dir))


@plan(
    f"""WITH {_tfidf("side3 = 'Left'")}, {_PERIODS}, {log_odds_cte('sides', '', '1.0')}
SELECT 'frequency' AS report, 'all' AS side, term, CAST(n AS DOUBLE) AS score FROM (SELECT * FROM kept ORDER BY n DESC, term LIMIT 30)
UNION ALL SELECT 'tfidf', 'all', term, s FROM (SELECT term, round(m, 6) AS s FROM mean ORDER BY round(m, 6) DESC, term LIMIT 30)
UNION ALL SELECT 'distinctive', side, term, log_odds FROM ({_DISTINCT})"""
)
def pairwise_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left before and after the cutoff, both together (``pairwise_reports`` has all pairs and each side): frequent terms, TF-IDF and distinctive terms."""
    tf, kept, n = _kept(spark, sf_dir, "side3 = 'Left'")
    frequent = ops.top(kept, "n", 30).select(F.lit("frequency").alias("report"), F.lit("all").alias("side"), "term", F.col("n").cast("double").alias("score"))
    weighted = ops.top(ops.tfidf_means(tf, kept, n).withColumn("score", F.round("tfidf_mean", 6)), "score", 30).select(F.lit("tfidf").alias("report"), F.lit("all").alias("side"), "term", "score")
    distinct = _distinctive(_periods(spark, sf_dir, "side3 = 'Left'")).select(F.lit("distinctive").alias("report"), "side", "term", F.col("log_odds").alias("score"))
    return frequent.unionByName(weighted).unionByName(distinct)


@plan(f"WITH {tokens(T1)}, sides AS (SELECT term, count(*) FILTER (side3 = 'Left') AS a, count(*) FILTER (side3 = 'Right') AS b FROM tok WHERE side3 IN ('Left', 'Right') GROUP BY term), {log_odds_cte('sides')} SELECT term, round(log_odds, 6) AS log_odds, round(z, 6) AS z_score FROM z")
def logodds_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.log_odds(ops.two_sides(ops.term_counts(_long(spark, sf_dir), "side3"), "side3", "Left", "Right"))
    return got.select("term", F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z_score"))


_PAIRS = [("Left vs Right, pre", "Left", "pre", "Right", "pre"), ("Left vs Right, post", "Left", "post", "Right", "post"), ("Left, pre vs post", "Left", "pre", "Left", "post"), ("Right, pre vs post", "Right", "pre", "Right", "post")]
_ROLES = [(name, role, side, period) for name, sa, pa, sb, pb in _PAIRS for role, side, period in (("a", sa, pa), ("b", sb, pb))]
_REPORTS = f"""{tokens(T2)}, {_STOP}, roles(comparison, side, side3, period) AS (VALUES {', '.join(str(r) for r in _ROLES)}),
docs AS (SELECT roles.comparison, roles.side, doc_id FROM speech JOIN roles ON speech.side3 = roles.side3 AND speech.period = roles.period),
mine AS (SELECT comparison, side, doc_id, term, count(*) AS tf FROM docs JOIN tok USING (doc_id) WHERE term NOT IN (SELECT term FROM stops) GROUP BY ALL),
nd AS (SELECT comparison, side, count(*) AS n_docs FROM docs GROUP BY ALL), ndp AS (SELECT comparison, sum(n_docs) AS n_docs FROM nd GROUP BY ALL),
kept AS (SELECT comparison, side, term, sum(tf) AS n, count(*) AS df, any_value(n_docs) AS n_docs FROM mine JOIN nd USING (comparison, side) GROUP BY ALL HAVING count(*) >= 5 AND count(*) <= 0.95 * any_value(n_docs)),
w AS (SELECT comparison, side, doc_id, term, tf * (ln((1 + n_docs) / (1 + df)) + 1) AS w, n_docs FROM mine JOIN kept USING (comparison, side, term)),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY comparison, side, doc_id)) AS u FROM w),
mean AS (SELECT comparison, side, term, round(sum(u) / any_value(n_docs), 6) AS m FROM u GROUP BY ALL),
sides AS (SELECT comparison, term, CAST(sum(CASE WHEN side = 'a' THEN tf ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN side = 'b' THEN tf ELSE 0 END) AS BIGINT) AS b
  FROM mine JOIN ndp USING (comparison) GROUP BY ALL HAVING count(*) >= 5 AND count(*) <= 0.95 * any_value(n_docs)), {log_odds_cte('sides', 'comparison', '1.0')},
d AS (SELECT comparison, CASE WHEN log_odds > 0 THEN 'a' ELSE 'b' END AS side, term, round(-log_odds, 6) AS s FROM z WHERE log_odds <> 0),
r AS (SELECT 'frequency' AS report, comparison, side, term, CAST(n AS DOUBLE) AS score, row_number() OVER (PARTITION BY comparison, side ORDER BY n DESC, term) AS k FROM kept
  UNION ALL SELECT 'tfidf', comparison, side, term, m, row_number() OVER (PARTITION BY comparison, side ORDER BY m DESC, term) FROM mean
  UNION ALL SELECT 'distinctive', comparison, side, term, s, row_number() OVER (PARTITION BY comparison, side ORDER BY abs(s) DESC, term) FROM d)"""


@plan(f"WITH {_REPORTS} SELECT report, comparison, side, term, score FROM r WHERE k <= 30")
def pairwise_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all four pairs: frequent terms and TF-IDF of each side, and distinctive terms."""
    group, pair = ["side3", "period"], "comparison"
    roles = F.broadcast(spark.createDataFrame(_ROLES, "comparison string, side string, side3 string, period string"))
    s = speeches(spark, sf_dir).filter(F.col("side3").isin("Left", "Right"))
    n_docs = F.broadcast(s.groupBy(*group).agg(F.count("*").alias("n_docs")))
    tf = ops.without(ops.document_counts(s, latin_words("text"), *group, "doc_id"), F.broadcast(_words(spark, STOPS)))
    stats = tf.groupBy(*group, "term").agg(F.sum("n").alias("n"), F.count("*").alias("df")).join(n_docs, group)
    usual = (F.col("df") >= 5) & (F.col("df") <= 0.95 * F.col("n_docs"))
    kept = stats.filter(usual)
    weighted = tf.select(*group, "doc_id", "term", F.col("n").alias("tf")).join(kept, [*group, "term"]).withColumn("w", F.col("tf") * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    unit = weighted.groupBy(*group, "doc_id", "n_docs").agg(F.collect_list(F.struct("term", "w")).alias("ws"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    unit = unit.select(*group, "n_docs", "length", F.inline("ws"))
    means = unit.groupBy(*group, "term").agg(F.round(F.sum(F.col("w") / F.col("length")) / F.first("n_docs"), 6).alias("score"))
    both = stats.join(roles, group).join(F.broadcast(n_docs.join(roles, group).groupBy(pair).agg(F.sum("n_docs").alias("all_docs"))), pair)
    pick = lambda v: F.sum(F.when(F.col("side") == v, F.col("n")).otherwise(0))
    both = both.groupBy(pair, "term").agg(pick("a").alias("a"), pick("b").alias("b"), F.sum("df").alias("df"), F.first("all_docs").alias("n_docs")).filter(usual)
    odds = ops.log_odds(both.select(pair, "term", "a", "b"), 1.0, pair).filter("log_odds <> 0")
    odds = odds.select(pair, F.when(F.col("log_odds") > 0, "a").otherwise("b").alias("side"), "term", F.round(-F.col("log_odds"), 6).alias("score")).withColumn("size", F.abs("score"))
    report = lambda name, df: df.select(F.lit(name).alias("report"), pair, "side", "term", "score")
    frequent = report("frequency", ops.ranked(kept.withColumn("score", F.col("n").cast("double")), 30, *group, score="score").join(roles, group))
    tfidf = report("tfidf", ops.ranked(means, 30, *group, score="score").join(roles, group))
    return frequent.unionByName(tfidf).unionByName(report("distinctive", ops.ranked(odds, 30, pair, "side", score="size")))


_PAIR_CTE = f"""counts AS (SELECT side3, period, term, count(*) AS n FROM tok WHERE side3 IN ('Left', 'Right') GROUP BY ALL),
pairs(comparison, sa, pa, sb, pb) AS (VALUES {', '.join(str(p) for p in _PAIRS)}),
sides AS (SELECT comparison, term, CAST(sum(CASE WHEN side3 = sa AND period = pa THEN n ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN side3 = sb AND period = pb THEN n ELSE 0 END) AS BIGINT) AS b
  FROM counts JOIN pairs ON (side3 = sa AND period = pa) OR (side3 = sb AND period = pb) GROUP BY ALL)"""


def _four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: counts by side and period, joined with the four comparisons."""
    counts = ops.term_counts(_long(spark, sf_dir).filter(F.col("side3").isin("Left", "Right")), "side3", "period")
    pairs = spark.createDataFrame(_ROLES, "comparison string, role string, side3 string, period string")
    return ops.log_odds(ops.two_sides(counts.join(F.broadcast(pairs), ["side3", "period"]), "role", "a", "b", "comparison"), 0.01, "comparison")


@plan(f"WITH {tokens(T1)}, {_PAIR_CTE}, {log_odds_cte('sides', 'comparison')} SELECT comparison, term, round(log_odds, 6) AS log_odds, round(z, 6) AS z_score FROM z")
def logodds_four_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four(spark, sf_dir).select("comparison", "term", F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z_score"))


@plan(
    f"""WITH {tokens(T1)}, {_PAIR_CTE}, {log_odds_cte('sides', 'comparison')}, r AS (SELECT comparison, term, round(z, 6) AS z_score,
  row_number() OVER (PARTITION BY comparison ORDER BY round(z, 6) DESC, term) AS up, row_number() OVER (PARTITION BY comparison ORDER BY round(z, 6), term) AS down FROM z WHERE z IS NOT NULL)
SELECT comparison, 'A' AS side, term, z_score FROM r WHERE up <= 20 UNION ALL SELECT comparison, 'B', term, z_score FROM r WHERE down <= 20"""
)
def logodds_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _four(spark, sf_dir).filter("z is not null").select("comparison", "term", F.round("z", 6).alias("z_score"))
    side = lambda name, up: ops.ranked(z, 20, "comparison", score="z_score", ascending=not up).select("comparison", F.lit(name).alias("side"), "term", "z_score")
    return side("A", True).unionByName(side("B", False))


@plan(f"WITH {tokens(T1)}, c AS (SELECT side3, period, term, count(*) AS n FROM tok WHERE side3 IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY side3, period ORDER BY n DESC, term) AS rank FROM c) SELECT side3, period, term, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20")
def top20_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ranked(ops.term_counts(_long(spark, sf_dir).filter("side3 is not null"), "side3", "period"), 20, "side3", "period")


def _polar(source: str = "tok") -> str:
    return f"sides AS (SELECT quarter, term, count(*) FILTER (side3 = 'Left') AS a, count(*) FILTER (side3 = 'Right') AS b FROM {source} WHERE side3 IN ('Left', 'Right') GROUP BY ALL), {log_odds_cte('sides', 'quarter')}, pol AS (SELECT quarter, avg(abs(z)) AS s FROM z WHERE ta > 0 AND tb > 0 GROUP BY quarter)"


def _counts(df: DataFrame, kind=words) -> DataFrame:
    return ops.term_counts(ops.terms(df, kind("text"), "quarter", "side3"), "quarter", "side3")


@plan(f"WITH {tokens(T1)}, {_polar()} SELECT quarter, round(s, 6) AS polarization_score FROM pol")
def polarization_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.polarization(_counts(speeches(spark, sf_dir).filter(F.col("side3").isin("Left", "Right"))))
    return got.select("quarter", F.round("polarization_score", 6).alias("polarization_score"))


def _jsd(source: str, name: str = "jsd") -> str:
    return f"""{name}_c AS (SELECT quarter, term, count(*) FILTER (side3 = 'Left') AS a, count(*) FILTER (side3 = 'Right') AS b FROM {source} WHERE side3 IN ('Left', 'Right') GROUP BY ALL),
{name}_p AS (SELECT *, a / sum(a) OVER (PARTITION BY quarter) AS p, b / sum(b) OVER (PARTITION BY quarter) AS q FROM {name}_c),
{name} AS (SELECT quarter, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS jsd,
  CAST(sum(a) AS BIGINT) AS left_tokens, CAST(sum(b) AS BIGINT) AS right_tokens FROM {name}_p GROUP BY quarter HAVING sum(a) > 0 AND sum(b) > 0)"""


_DOCS = "docs AS (SELECT quarter, count(*) FILTER (side3 = 'Left') AS left_n, count(*) FILTER (side3 = 'Right') AS right_n FROM {} GROUP BY quarter)"


def _with_documents(jsd: DataFrame, docs: DataFrame) -> DataFrame:
    n = docs.groupBy("quarter").agg(F.count_if(F.col("side3") == "Left").alias("left_n"), F.count_if(F.col("side3") == "Right").alias("right_n"))
    return jsd.join(n, "quarter").select("quarter", F.round("jsd", 6).alias("jsd_all_words"), "left_n", "right_n", "left_tokens", "right_tokens")


@plan(f"WITH {tokens(T3)}, {_jsd('tok')}, {_DOCS.format('speech')} SELECT jsd.quarter, round(jsd, 6) AS jsd_all_words, left_n, right_n, left_tokens, right_tokens FROM jsd JOIN docs ON jsd.quarter = docs.quarter")
def jsd_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speeches(spark, sf_dir).filter(F.col("side3").isin("Left", "Right"))
    return _with_documents(ops.jensen_shannon(_counts(s, split_words)), s)


_TARGETS = """n AS (SELECT quarter, count(*) FILTER (side3 = 'Left') AS n_left, count(*) FILTER (side3 = 'Right') AS n_right FROM speech GROUP BY quarter HAVING count(*) FILTER (side3 = 'Left') > 0 AND count(*) FILTER (side3 = 'Right') > 0),
t AS (SELECT quarter, n_left, n_right, n_left + n_right AS total, min(n_left + n_right) OVER () AS target_n FROM n),
targets AS (SELECT *, CAST(round_even(target_n * (n_left / total), 0) AS BIGINT) AS target_left, target_n - CAST(round_even(target_n * (n_left / total), 0) AS BIGINT) AS target_right FROM t),
numbered AS (SELECT *, row_number() OVER (PARTITION BY quarter, side3 ORDER BY md5('42:' || doc_id), doc_id) AS nth FROM speech WHERE side3 IN ('Left', 'Right')),
equal AS (SELECT numbered.* FROM numbered JOIN targets ON numbered.quarter = targets.quarter WHERE nth <= CASE WHEN side3 = 'Left' THEN target_left ELSE target_right END)"""


@plan(f"WITH {SPEECH}, {_TARGETS} SELECT quarter, n_left, n_right FROM n")
def eligible_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.targets(speeches(spark, sf_dir)).select("quarter", "n_left", "n_right")


@plan(f"WITH {SPEECH}, {_TARGETS} SELECT quarter, n_left, n_right, total, target_n, target_left, target_right FROM targets")
def equalize_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.targets(speeches(spark, sf_dir))


@plan(f"WITH {SPEECH}, {_TARGETS} SELECT doc_id, quarter, side3 FROM equal")
def equalize_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.equalized(speeches(spark, sf_dir)).select("doc_id", "quarter", "side3")


_EQUAL_TOKENS = "eq AS (SELECT quarter, side3, unnest({}) AS term FROM equal)"


@plan(f"WITH {SPEECH}, {_TARGETS}, {_EQUAL_TOKENS.format(T3)}, {_jsd('eq')}, {_DOCS.format('equal')} SELECT jsd.quarter, round(jsd, 6) AS jsd_all_words, left_n, right_n, left_tokens, right_tokens FROM jsd JOIN docs ON jsd.quarter = docs.quarter")
def jsd_equalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = resample.equalized(speeches(spark, sf_dir))
    return _with_documents(ops.jensen_shannon(_counts(s, split_words)), s)


@plan(f"WITH {tokens(T3)}, {_TARGETS}, {_EQUAL_TOKENS.format(T3)}, {_jsd('tok')}, {_jsd('eq', 'jsd_equal')} SELECT jsd.quarter, round(jsd.jsd, 6) AS jsd, round(jsd_equal.jsd, 6) AS jsd_equal FROM jsd JOIN jsd_equal ON jsd.quarter = jsd_equal.quarter")
def jsd_equalized_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = jsd_quarter(spark, sf_dir).select("quarter", F.col("jsd_all_words").alias("jsd"))
    return a.join(jsd_equalized(spark, sf_dir).select("quarter", F.col("jsd_all_words").alias("jsd_equal")), "quarter")


@plan(f"WITH {SPEECH}, {_TARGETS}, {_EQUAL_TOKENS.format(T1)}, {_polar('eq')} SELECT quarter, round(s, 6) AS polarization_score FROM pol")
def polarization_equalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ops.polarization(_counts(resample.equalized(speeches(spark, sf_dir))))
    return got.select("quarter", F.round("polarization_score", 6).alias("polarization_score"))


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents of both sides, the largest quarter, its sizes before and after, and its sample of the smallest's sizes."""
    s = speeches(spark, sf_dir).filter(F.col("side3").isin("Left", "Right"))
    n = resample.targets(s)
    big = n.orderBy(F.desc("total"), "quarter").limit(1).select("quarter", "n_left", "n_right")
    small = n.orderBy("total", "quarter").limit(1).select(F.col("quarter").alias("quarter_small"), F.col("n_left").alias("sl"), F.col("n_right").alias("sr"))
    want = big.crossJoin(small).withColumn("l", F.least("n_left", "sl")).withColumn("r", F.least("n_right", "sr"))
    wanted = want.select("quarter", F.explode(F.create_map(F.lit("Left"), "l", F.lit("Right"), "r")).alias("side3", "wanted"))
    return s, big, want, resample.take(s, wanted, "quarter", "side3")


@plan(
    f"""WITH {tokens(T1)}, {_TARGETS}, big AS (SELECT * FROM n ORDER BY n_left + n_right DESC, quarter LIMIT 1), small AS (SELECT * FROM n ORDER BY n_left + n_right, quarter LIMIT 1),
want AS (SELECT big.quarter, least(big.n_left, small.n_left) AS l, least(big.n_right, small.n_right) AS r, big.n_left, big.n_right, small.quarter AS quarter_small FROM big, small),
down AS (SELECT numbered.quarter, numbered.side3, unnest({T1}) AS term FROM numbered JOIN want ON numbered.quarter = want.quarter WHERE nth <= CASE WHEN side3 = 'Left' THEN l ELSE r END),
{_polar('(SELECT 0 AS part, quarter, side3, term FROM tok UNION ALL SELECT 1, quarter || chr(39), side3, term FROM down)')}
SELECT want.quarter AS quarter_big, quarter_small, round(o.s, 6) AS original_polarization, round(e.s, 6) AS downsampled_polarization, n_left AS left_big_original_n, n_right AS right_big_original_n, l AS left_big_downsample_n, r AS right_big_downsample_n
FROM want JOIN pol o ON o.quarter = want.quarter JOIN pol e ON e.quarter = want.quarter || chr(39)"""
)
def downsample_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest quarter sampled down to the sides of the smallest."""
    s, big, want, taken = _pair(spark, sf_dir)
    down = ops.polarization(_counts(taken))
    whole = ops.polarization(_counts(s.join(big.select("quarter"), "quarter", "left_semi")))
    got = want.join(whole, "quarter").join(down.withColumnRenamed("polarization_score", "down"), "quarter")
    return got.select(F.col("quarter").alias("quarter_big"), "quarter_small", F.round("polarization_score", 6).alias("original_polarization"), F.round("down", 6).alias("downsampled_polarization"), F.col("n_left").alias("left_big_original_n"), F.col("n_right").alias("right_big_original_n"), F.col("l").alias("left_big_downsample_n"), F.col("r").alias("right_big_downsample_n"))


def _per_document(df: DataFrame) -> DataFrame:
    return ops.document_counts(df, words("text"), "quarter", "doc_id", "side3")


@plan()
def permutation_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides shuffled over all documents of a quarter, 500 times."""
    counts = _per_document(speeches(spark, sf_dir))
    return resample.permutation_test(counts, ops.polarization(counts))


@plan()
def polarization_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The equal-size sample's p-values, shuffled over Left and Right, and whether they are below 0.05."""
    counts = _per_document(resample.equalized(speeches(spark, sf_dir)))
    return resample.permutation_test(counts, ops.polarization(counts)).withColumn("significant", F.col("p_value") < 0.05)


@plan()
def downsample_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of the largest quarter, shuffled over all its documents, and of its sample of the smallest's sizes."""
    _, big, want, taken = _pair(spark, sf_dir)
    whole = _per_document(speeches(spark, sf_dir).join(big.select("quarter"), "quarter", "left_semi"))
    p = lambda counts, name: resample.permutation_test(counts, ops.polarization(counts)).select("quarter", F.col("p_value").alias(name))
    got = want.join(p(whole, "original_p_value"), "quarter", "left").join(p(_per_document(taken), "downsampled_p_value"), "quarter", "left")
    return got.select(F.col("quarter").alias("quarter_big"), "quarter_small", "original_p_value", "downsampled_p_value")
