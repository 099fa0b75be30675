"""Hand-computed cases."""

import math

from pyspark.sql import functions as F

from lexiquarry.functions.text import fix_mojibake, ngrams, overlapping_chunks, words
from lexiquarry.operators import cleaning, lexstats, resample, shares


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first().x


def test_words_and_ngrams(spark):
    assert one(spark, words("t"), t="La Salute, è un_bene: 12 345 a") == ["salute", "un_bene", "345"]
    assert one(spark, ngrams(words("t"), 1, 2), t="uno due tre") == ["uno", "due", "tre", "uno due", "due tre"]
    assert one(spark, fix_mojibake("t"), t="perchÃ© Ã¨") == "perché è"


def test_chunks(spark):
    got = one(spark, overlapping_chunks(F.split("t", " "), 4, 1), t="a b c d e f g h")
    assert got == [["a", "b", "c", "d"], ["d", "e", "f", "g"], ["g", "h"]]


def test_infer_speakers(spark):
    rows = spark.createDataFrame([(1, "PRESIDENTE", "ROSSI MARIO. Ha"), (2, None, "Anna Bianchi (PD) dice"), (3, "", "niente"), (4, "Verdi", "NERI LUCA. x")], "id int, speaker string, text string")
    got = {r.id: (r.speaker, r.inferred_flag) for r in cleaning.infer_speakers(rows).collect()}
    assert got == {1: ("ROSSI MARIO", 1), 2: ("Anna Bianchi", 1), 4: ("Verdi", 0)}


def test_crosswalk_keeps_unmatched(spark):
    rows = spark.createDataFrame([("Lega", 1), ("x", 2)], "party_name string, n int")
    sides = spark.createDataFrame([("Lega", "Right", "Right"), ("Chair", "", "Other")], "party_name string, side3 string, side5 string")
    assert cleaning.crosswalk(rows, sides).count() == 3
    assert cleaning.crosswalk(rows, sides, keep_unmatched=False).count() == 2


def test_missing_and_null_flags(spark):
    rows = spark.createDataFrame([(1, " "), (None, "a")], "n int, s string")
    assert {tuple(r) for r in cleaning.missing_counts(rows).collect()} == {("n", 1), ("s", 1)}
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, f boolean")
    assert sorted(r.id for r in shares.not_false(flags, "f").collect()) == [1, 3]


def _counts(spark, rows):
    return spark.createDataFrame(rows, "quarter string, side3 string, term string, n long")


def test_log_odds_is_antisymmetric(spark):
    c = _counts(spark, [("q", "Left", "a", 3), ("q", "Right", "a", 1), ("q", "Left", "b", 2), ("q", "Right", "c", 4)])
    one_way = {r.term: r.z for r in lexstats.log_odds(lexstats.two_sides(c, "side3", "Left", "Right")).collect()}
    other = {r.term: r.z for r in lexstats.log_odds(lexstats.two_sides(c, "side3", "Right", "Left")).collect()}
    assert all(math.isclose(one_way[t], -other[t]) for t in "abc")
    pa, pb = 3.01 / 5.03, 1.01 / 5.03
    lo = math.log(pa / (1 - pa)) - math.log(pb / (1 - pb))
    assert math.isclose(one_way["a"], lo / math.sqrt(1 / 3.01 + 1 / 1.01))


def test_jensen_shannon_bounds(spark):
    c = _counts(spark, [("same", "Left", "a", 2), ("same", "Right", "a", 7), ("apart", "Left", "a", 1), ("apart", "Right", "b", 1), ("half", "Left", "a", 1)])
    got = {r.quarter: r.jsd for r in lexstats.jensen_shannon(c).collect()}
    assert got == {"same": 0.0, "apart": 1.0}


def test_equalized_sizes(spark):
    rows = [(k, f"q{k % 3}", "Left" if k % 4 else "Right", "t") for k in range(90)]
    got = resample.equalized(spark.createDataFrame(rows, "doc_id long, quarter string, side3 string, text string"))
    assert len({r["count"] for r in got.groupBy("quarter").count().collect()}) == 1


def test_permutation_is_repeatable(spark):
    rows = [("q", d, "Left" if d < 6 else "Right", t, 1 + (d + k) % 3) for d in range(12) for k, t in enumerate("abcd") if (d + k) % 2]
    c = spark.createDataFrame(rows, "quarter string, doc_id long, side3 string, term string, n long")
    p = [resample.permutation_test(c, lexstats.polarization(c), iterations=40, blocks=2).first().p_value for _ in range(2)]
    assert p[0] == p[1] and 0 <= p[0] <= 1


def test_permutation_test_by_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [("q", d, side, f"t{t}", int(r.integers(1, 4))) for d in range(12) for side in [["Left", "Right", "Center"][d % 3]] for t in r.choice(15, 6, replace=False)]
    counts = spark.createDataFrame(rows, "quarter string, doc_id long, side3 string, term string, n long")
    observed = lexstats.polarization(counts)
    got = resample.permutation_test(counts, observed, iterations=37, blocks=3).collect()
    score = lambda left, right: next((x.polarization_score for x in lexstats.polarization(spark.createDataFrame([("q", s, t, n) for _, d, _, t, n in rows for s, ds in (("Left", left), ("Right", right)) if d in ds] or [("q", "", "", 0)], "quarter string, side3 string, term string, n long")).collect()), None)
    which = np.array([1, 2, 0] * 4, np.uint8)
    shuffles = [np.random.default_rng([42, k, *b"q"]).permutation(which) for k in range(37)]
    scores = [score(set(np.flatnonzero(x == 1)), set(np.flatnonzero(x == 2))) for x in shuffles]
    base = observed.first().polarization_score
    assert len(got) == 1 and math.isclose(got[0].observed, base)
    assert math.isclose(got[0].p_value, np.mean([x >= base for x in scores if x is not None]))


def test_coherence_by_brute_force(spark):
    from lexiquarry.operators import topics

    texts = ["a b c a d e f", "b a", "c d c d x y a b", "e f e f"]
    words = {0: ["a", "b", "c"], 1: ["d", "e", "q"]}
    windows = [set(t[k : k + 3]) for t in (x.split() for x in texts) for k in range(max(1, len(t) - 2))]
    n = len(windows)

    def v(x, y):
        nx, ny, m = (sum(s <= w for w in windows) for s in ({x}, {y}, {x, y}))
        return math.log((m / n + 1e-12) / (nx / n * ny / n)) / -math.log(m / n + 1e-12) if nx and ny else 0.0

    want = {}
    for k, ws in words.items():
        rows = [[v(x, y) for y in ws] for x in ws]
        total = [sum(c) for c in zip(*rows)]
        norm = lambda a: math.sqrt(sum(x * x for x in a))
        want[k] = sum(sum(x * y for x, y in zip(r, total)) / (norm(r) * norm(total)) if norm(r) and norm(total) else 0.0 for r in rows) / len(ws)
    w = spark.createDataFrame([(k, i, t) for k, ws in words.items() for i, t in enumerate(ws)], "topic int, rank int, term string")
    t = spark.createDataFrame([(i, x.split()) for i, x in enumerate(texts)], "doc_id long, tokens array<string>")
    got = {r.topic: r.coherence for r in topics.cv_coherence(w, t, 3).collect()}
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_health_topics(spark):
    from lexiquarry.operators import topics
    from lexiquarry.operators.stopwords import HEALTH_PREFIXES, HEALTH_QUERY

    w = spark.createDataFrame([(1, 1, "salute"), (1, 2, "ospedale"), (2, 1, "Sanità"), (2, 2, "cane"), (3, 1, "gatto"), (3, 2, "cane")], "topic int, rank int, term string")
    assert {r.topic: r.by_keywords for r in topics.keyword_topics(w, HEALTH_PREFIXES).collect()} == {1: True, 2: True, 3: False}
    sims = {r.topic: r.similarity for r in topics.phrase_similarity(w, HEALTH_QUERY).collect()}
    assert sims[3] == 0 == sims[2] and math.isclose(sims[1], 2 / math.sqrt(2 * len(HEALTH_QUERY.split())), abs_tol=1e-6)
    encoder = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert {r.topic for r in topics.encoded_similarity(w, HEALTH_QUERY, encoder).collect()} == {1, 2, 3}


def test_lemmas_and_parts_of_speech(spark):
    from lexiquarry.operators.lemmas import CONTENT, file_label, lemmatized, masked_mean

    def analyse(texts):
        return [[(w, w.rstrip("s") or w, "VERB" if w.endswith("va") else "NOUN") for w in t.split()] for t in texts]

    docs = spark.createDataFrame([(1, "Gatti e Cani parlava 12 x canis"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text_repro for r in lemmatized(docs, analyse, {"e", "cani"}).collect()}
    assert got == {1: "gatti parlava", 2: ""}
    assert {r.doc_id: r.text_repro for r in lemmatized(docs, analyse, {"e"}, CONTENT, 3).collect()} == {1: "gatti cani cani", 2: ""}
    assert masked_mean([[[1.0, 2.0], [3.0, 4.0]]], [[1, 0]]).tolist() == [[1.0, 2.0]]
    assert file_label("Left pre", "Right") == "Left_pre_vs_Right"


def test_separators_and_encodings(spark, tmp_path):
    import pytest

    from lexiquarry.sources import readers

    for sep in readers.SEPARATORS:
        (tmp_path / "utf.csv").write_text(f'a{sep}b\n1{sep}"città{sep} ""x"" "\n', encoding="utf-8")
        (tmp_path / "latin.csv").write_bytes(f"a{sep}b\n1{sep}città\n".encode("latin-1"))
        for name, text in (("utf", f'città{sep} "x" '), ("latin", "città")):
            assert [tuple(r) for r in readers.read_csv(spark, f"file://{tmp_path}/{name}.csv", "a int, b string").collect()] == [(1, text)]
    spark.range(3).write.parquet(f"{tmp_path}/main")
    assert readers.dataset(spark, "main", {"main": f"{tmp_path}/main"}).count() == 3
    with pytest.raises(ValueError):
        readers.dataset(spark, "other", {})
    readers.write_csv(spark.range(4).toDF("n"), f"{tmp_path}/one", one_file=True)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1


def test_encoder_and_pooling(spark):
    from lexiquarry.operators import topics

    chunks = spark.createDataFrame([(1, 0, 102, "aa"), (1, 1, 102, "bbbb"), (2, 0, 2, None)], "doc_id long, position int, len int, text string")
    vectors = topics.embed(chunks.withColumn("doc_id", F.col("doc_id") * 10 + F.col("position")), lambda ts: [[len(t) - 9.0, 1.0] for t in ts])
    back = vectors.select(F.floor(F.col("doc_id") / 10).alias("doc_id"), (F.col("doc_id") % 10).cast("int").alias("position"), "vector")
    from pyspark.ml.functions import vector_to_array

    joined = chunks.drop("text").join(back, ["doc_id", "position"]).withColumn("v", vector_to_array("vector"))
    got = {r.doc_id: r.pooled for r in topics.pooled(joined, "doc_id", "position", "len", "v", 50).collect()}
    assert [round(x, 9) for x in got[1]] == [round((2 * 100 + 4 * 50) / 150, 9), 1.0] and got[2] == [0.0, 1.0]
