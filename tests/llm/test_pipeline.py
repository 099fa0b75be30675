"""The pipeline's decisions on a small corpus with planted cases."""

import random

import corpus_pipeline
from lexiquarry.llm.common import staged


def test_pipeline(spark, tmp_path):
    r = random.Random(8)
    words = {"en": "the of and to in is that for was with on as by at".split(), "de": "der die und das nicht ist für mit über auch auf dem ein".split()}
    fresh = lambda k: " ".join("".join(r.choice(words[k]) for _ in range(r.randint(1, 3))) for _ in range(60))
    clean = {k: (fresh(lang), lang) for k, lang in enumerate(["en", "de"] * 20)}
    item = "this benchmark question asks which of the four given answers is right"
    passage = " ".join(f"shared{k}" for k in range(40))
    planted = {100: clean[3][0], 101: clean[4][0].replace(" ", "\n"), 102: "123 456 !!!", 103: None, 104: fresh("en") + " " + item, 105: fresh("en") + " " + passage, 106: fresh("de") + " " + passage}
    rows = [(k, t, lang, "s", len(t)) for k, (t, lang) in clean.items()] + [(k, t, "en", "s", len(t or "")) for k, t in planted.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, str(tmp_path)), "test")
        ids = {x.doc_id for x in docs.select("doc_id").collect()}
        left.append(ids)
        if k < 4:
            assert docs.columns == columns
        if k == 2:
            got = {x.doc_id: x for x in docs.collect()}
            assert passage in got[105].text and passage[:-5] not in got[106].text and got[106].n_chars == len(got[106].text)
    everything = {*clean, *planted}
    assert left[0] == everything - {102, 103}
    assert left[1] == left[0] - {100, 101}
    assert left[2] == left[1]
    assert left[3] == left[4] == left[2] - {104}
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left[4]


def test_stages_carry_rows_as_they_are(spark):
    """Null and repeated doc_ids, and columns with the names that stages and operators use themselves."""
    long = "a passage of many words that is more than a hundred bytes long and that two documents of this table have in common"
    rows = [(1, "one two three four five six seven", "mine", "r"), (1, "one two three four five six seven", "yours", "r"), (None, "alpha beta gamma delta epsilon " + long, "n", None), (None, None, "null", "x"), (7, "other words stand here before it " + long, "late", "y"), (9, "", "empty", "z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), a, b, a, 5) for i, t, a, b in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, row string, kept string, key int")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    left = got.collect()
    assert len(left) == 5 and {r["_id"] for r in left} >= {"n", "null", "late", "empty"} and all(r["_id"] == r["kept"] and r["key"] == 5 for r in left)
    got = corpus_pipeline.repeated_passages(spark, docs.filter("_id != 'yours'"), "")
    assert got.columns == docs.columns
    cut = {r["_id"]: r for r in got.collect()}
    assert (cut["late"].text, cut["late"].n_chars) == ("other words stand here before it", 32)
    assert cut["n"].text.endswith(long) and cut["mine"].row == "r"
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0 == corpus_pipeline.repeated_passages(spark, docs.limit(0), "").count()
