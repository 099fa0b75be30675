"""Cases of the reviewer's findings, each of which failed before."""

import uuid

from pyspark.sql import functions as F


def saved(spark, tmp_path, rows, schema, name="documents"):
    sf = f"{tmp_path}/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/{name}.parquet")
    return sf


DOCS = "doc_id long, text string, source string"


def test_csv_keeps_white_space_empty_texts_and_replacement_characters(spark, tmp_path):
    from lexiquarry.plans import cleaning

    odd = [" lead", "trail ", "\t", "\r", "\n", "", " ", "\x00z", "a\r\nb", '"', '""', "\\", "x;y", None]
    for more in ([], ["a�b"]):
        rows = [(k, t, t) for k, t in enumerate([*odd, *more, "città"])]
        assert sorted(tuple(r) for r in cleaning.scan_csv(spark, saved(spark, tmp_path, rows, DOCS)).collect()) == rows


def test_lda_pass_reads_every_document_once_and_infers_as_a_plain_loop(spark):
    import numpy as np

    from lexiquarry.operators import lda

    r = np.random.default_rng(5)
    texts = [[f"w{x}" for x in r.integers(0, 30, n)] for n in (0, 1, 3, 40, 40, 41, 200)] + [None, ["x"], ["w1", None]]
    table = lda.counted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, tokens array<string>"), 1, 0.9, 100)
    known = set(table.vocabulary)
    beta = r.random((len(table.vocabulary), 4)).astype(np.float32) + 0.1
    got, alpha, want = lda._pass(table.packs, beta, 0.25), 0.25, np.zeros((len(table.vocabulary), 4))
    for t in texts:
        words = [table.vocabulary.index(w) for w in t or [] if w in known]
        if not words:
            continue
        gamma = np.full(4, alpha + len(words) / 4)
        for _ in range(lda.ITERATIONS):
            theta = np.exp(lda.psi(gamma))
            part = beta[words] * theta
            part /= part.sum(1, keepdims=True)
            new = alpha + part.sum(0)
            done, gamma = np.abs(new - gamma).mean() < lda.CHANGE, new
            if done:
                break
        part = beta[words] * np.exp(lda.psi(gamma))
        np.add.at(want, words, part / part.sum(1, keepdims=True))
    table.free()
    assert np.isclose(got.sum(), sum(w in known for t in texts for w in t or []), rtol=1e-5)
    assert np.allclose(got, want, atol=0.02)


def test_lda_of_no_words(spark):
    from lexiquarry.operators import topics

    t = spark.createDataFrame([(1, ["a"]), (2, None)], "doc_id long, tokens array<string>")
    model = topics.fit_lda(t, 3)
    assert model.stages[1].log_perplexity(t) is None
    assert sorted((r.doc_id, r.topic, round(r.p_max, 6)) for r in topics.lda_documents(model, t).collect()) == [(1, None, 0.333333), (2, None, 0.333333)]


def test_coherence_counts_windows_of_long_texts(spark):
    from lexiquarry.operators import topics

    words = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "c")], "topic int, rank int, term string")
    text = [("abcx" * 3)[k * k % 7 % 4 + k % 5] if k % 9 == 0 else "y" for k in range(9000)]
    got = {(r.a, r.b): r.m for r in topics._in_windows(words, spark.createDataFrame([(1, text), (2, None), (3, [])], "doc_id long, tokens array<string>"), 4).collect()}
    windows = [set(text[k : k + 4]) for k in range(len(text) - 3)]
    want = {p: sum(set(p) <= w for w in windows) for p in (("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("b", "c"))}
    assert got == {p: n for p, n in want.items() if n}


def test_nearest_vectors_by_brute_force(spark, monkeypatch):
    import numpy as np

    from lexiquarry.functions.vectors import cosine
    from lexiquarry.operators import nearest, topics

    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(230)]
    rows += [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0]), (400, [float("nan"), 1.0, 0.0, 0.0]), (303, [0.0] * 4), (None, [1.0, 0.0, 0.0, 0.0]), (500, [0.0] * 4), (304, [float("inf"), 1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(nearest, "BLOCK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = topics.by_rank(nearest.nearest(v, F.col("vec_id") % 10 == 0), 5, "query_id", "cosine", "vec_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("cosine"))
    want = topics.by_rank(pairs, 5, "query_id", "cosine", "vec_id").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 5 * (23 + 3)


def test_documents_are_counted_without_an_exchange_also_where_ids_repeat(spark, tmp_path):
    from collections import Counter

    from lexiquarry.plans import lexical

    texts = [(1, "b a b  a c"), (2, ""), (3, None), (4, "uno Uno due tre uno due"), (5, "x" * 5000 + " y")]
    for rows in (texts, [*texts, (1, "a d"), (None, "q q"), (None, "q"), (3, "zwei")]):
        sf = saved(spark, tmp_path, [(i, t, "s1") for i, t in rows], DOCS)
        plain, stop = Counter(), Counter()
        for i, t in rows:
            plain.update((i, w) for w in (t or "").split())
            stop.update((i, w.lower()) for w in (t or "").split() if len(w) > 2)
        for name, want in (("tokenize_ws", plain), ("tokenize_words", stop)):
            got = getattr(lexical, name)(spark, sf).collect()
            assert sorted(((r.doc_id, r.term, r.n) for r in got), key=repr) == sorted(((*k, n) for k, n in want.items()), key=repr)
        grams = {(r.doc_id, r.gram): r.n for r in lexical.ngrams(spark, sf).collect()}
        assert grams[4, "uno"] == 3 and grams[4, "uno due"] == 2 and grams[4, "tre uno"] == 1
    plan = lexical.tokenize_ws(spark, saved(spark, tmp_path, [(i, t, "s1") for i, t in texts], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan


def test_topic_fit_computes_documents_once_and_once_for_the_result(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from lexiquarry.operators import topics

    r = np.random.default_rng(3)
    means = [[1, 0, 0, 0]] * 40 + [[0, 1, 0, 0]] * 30 + [[0, 0, 1, 0]] * 5 + [[1, 0, 0, 0.3]]
    rows = [(i if i else None, [float(x) for x in (m + 0.01 * r.standard_normal(4)) * (1 + i % 3)]) for i, m in enumerate(np.array(means, float))]
    seen, kept = spark.sparkContext.accumulator(0), spark._jsc.sc().getPersistentRDDs().size()

    def computed(row):
        seen.add(1)
        return row

    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(computed), "doc_id long, values array<double>")
    found = topics.fit_topics(docs.select("doc_id", array_to_vector("values").alias("vector")), k=3, dims=3)
    assert seen.value == len(rows) and spark._jsc.sc().getPersistentRDDs().size() <= kept
    got = {x.doc_id: x.topic for x in found.collect() if x.is_outlier == (x.topic == -1)}
    assert seen.value == 2 * len(rows) and len(got) == len(rows)
    first, second = ({got[rows[i][0]] for i in range(*at)} for at in ((0, 40), (40, 70)))
    assert len(first) == len(second) == 1 and first != second and -1 not in first | second
    assert {got[i] for i in range(70, 76)} == {-1}
