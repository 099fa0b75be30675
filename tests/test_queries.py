"""Every query with SQL gives the same rows as DuckDB; the others run and hold their invariants."""

import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _registry():
    from lexiquarry import registry

    return registry


@pytest.mark.parametrize("name", sorted(_registry().ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = _registry().QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    got = duck.execute(_registry().ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == sorted((tuple(r[i] for i in at) for r in got.fetchall()), key=repr)


def test_lda_distributions(spark):
    rows = _registry().QUERIES["lda_doc_topics"](spark, SF).collect()
    assert len(rows) == 200
    for r in rows:
        p = [r[f"topic_{k}"] for k in range(20)]
        assert abs(sum(p) - 1) < 1e-6 and max(p) == r["p_max"]
        assert r["topic"] is None if max(p) == min(p) else p[r["topic"]] == max(p)


def test_lda_reads_the_documents_ten_times(spark, monkeypatch):
    from lexiquarry.plans import topics

    fits, real = [], topics.ops.fit_lda
    monkeypatch.setattr(topics.ops, "fit_lda", lambda *a, **k: fits.append(real(*a, **k)) or fits[-1])
    monkeypatch.setattr(topics, "_fits", {})
    for name in ("lda_topics", "lda_fit", "lda_coherence"):
        _registry().QUERIES[name](spark, SF)
    assert len(fits) == 5
    assert all(m.stages[1].getSubsamplingRate() * m.stages[1].getMaxIter() == 10 for m in fits)


def test_reports_of_all_pairs_and_sides(spark):
    rows = _registry().QUERIES["pairwise_reports"](spark, SF).collect()
    assert len({(r.report, r.comparison, r.side) for r in rows}) == 3 * 4 * 2


def test_downsampled_p_values(spark):
    q = _registry().QUERIES
    (got,), (pair,) = q["downsample_pvalues"](spark, SF).collect(), q["downsample_pair"](spark, SF).collect()
    assert (got.quarter_big, got.quarter_small) == (pair.quarter_big, pair.quarter_small)
    assert got.original_p_value == {r.quarter: r.p_value for r in q["permutation_pvalue"](spark, SF).collect()}[got.quarter_big]
    assert 0 <= got.downsampled_p_value <= 1


def test_csv_round_trip(spark):
    a = _registry().QUERIES["scan_csv"](spark, SF).collect()
    b = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    assert sorted(a) == sorted(b)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
