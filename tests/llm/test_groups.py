"""Near duplicates, vectors and the language model against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from lexiquarry.llm import kneser_ney
from lexiquarry.llm.components import components
from lexiquarry.llm.embedding_dedup import embedding_dedup, encode, fit
from lexiquarry.llm.near_dedup import across, bag_min_hash, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def bag(t):
    w = WORD.findall(lower(t))
    n = min(5, len(w))
    return collections.Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else {}


def overlap(a, b):
    common = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return common / (sum(a.values()) + sum(b.values()) - common)


def classes(pairs, linked):
    root = {k: k for k in range(len(pairs))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(pairs))]


def test_near_dedup(rows):
    r = random.Random(4)
    words = ["w%d" % k for k in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([1, 3, 6, 40, 120, 200]))] for _ in range(25)]
    pairs = [(k, " ".join(b)) for k, b in enumerate(base)]
    for k in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        pairs.append((100 + k, r.choice([" ", "\n", "  "]).join(w)))
    pairs += [(400, None), (401, ""), (402, " "), (403, "a a a a a a a a a a a a"), (404, "A a a a a a a a a a a a a"), (405, "long word " * 3000), (406, "long word " * 3000), (7, pairs[7][1]), (None, pairs[3][1])]
    pairs.sort(key=lambda p: (p[0] is not None, p[0] or 0, (p[1] or "").encode()))
    bags = [bag(t) for _, t in pairs]
    least = classes(pairs, lambda a, b: bool(bags[a]) and bool(bags[b]) and overlap(bags[a], bags[b]) >= 0.8)
    expected = sorted((repr(i), repr(pairs[least[k]][0])) for k, (i, _) in enumerate(pairs))
    got = near_dedup(rows(pairs)).collect()
    assert sorted((repr(x.doc_id), repr(x.class_id)) for x in got) == expected
    assert sum(x.kept for x in got) == len(set(least))
    assert near_dedup(rows([])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    shingle = np.arange(1, 61, dtype=np.uint64)
    a, b = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
    sig = bag_min_hash(doc, np.concatenate([shingle[a > 0], shingle[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 6000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 6000)


def test_links_between_components(spark):
    import zstandard

    z = zstandard.ZstdCompressor()
    texts = {k: " ".join(f"{c}{n}" for n in range(60)) for k, c in enumerate("aaabbbc")}
    table = spark.createDataFrame([(k, bytearray(np.full(168, ord(t[0]), np.uint16).tobytes()), [7] * 28, bytearray(z.compress(t.encode()))) for k, t in texts.items()], "key long, signature binary, buckets array<long>, text binary")
    members = spark.createDataFrame([(7, 0, k, k) for k in texts], "bucket long, band int, key long, label long")
    links = across(members, table, 0.6, 0.8, 4).collect()
    assert len(links) == 4
    linked = {r.node: r.label for r in components(spark.createDataFrame([(x.a, x.b) for x in links], "a long, b long"), "t").collect()}
    assert linked == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_a_stranger_is_compared_with_each_member_of_a_large_component(spark, monkeypatch):
    import zstandard

    from lexiquarry.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK", 4)
    sent, real = [], module.deal
    monkeypatch.setattr(module, "deal", lambda df, *a: sent.append(df.count()) or real(df, *a))
    z = zstandard.ZstdCompressor()
    text = lambda k: " ".join(f"{'a' if k < 30 else 'ab'[k % 2]}{n}" for n in range(60))
    keys = range(33)
    table = spark.createDataFrame([(k, bytearray(np.full(168, 1, np.uint16).tobytes()), [7] * 28, bytearray(z.compress(text(k).encode()))) for k in keys], "key long, signature binary, buckets array<long>, text binary")
    members = spark.createDataFrame([(7, 0, k, 0 if k < 30 else k) for k in keys], "bucket long, band int, key long, label long")
    links = across(members, table, 0.6, 0.8, 4).collect()
    edges = [(x.a, x.b) for x in links] + [(k, k + 1) for k in range(29)]
    linked = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert linked == {**dict.fromkeys(range(31), 0), 32: 0}
    assert sent[0] < 33 + 30 + 8 * 3


def test_components(spark):
    edges = [(1, 2), (3, 2), (2, 1), (5, 5), (9, 8), (8, 7), *((k, k + 1) for k in range(100, 140))]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(100, 141), 100)}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_embedding_dedup(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 64))
    near = [b + s * r.standard_normal(64) for b in base for s in (0.05, 0.2, 0.3, 0.33)]
    vectors = [v.tolist() for v in [*base, *near]]
    pairs = list(enumerate(vectors)) + [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [None] + [1.0] * 63), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (3, vectors[3]), (None, vectors[5]), (907, vectors[5])]
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in pairs]
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is not None, pairs[k][0] or 0))
    pairs, ok = [pairs[k] for k in order], [ok[k] for k in order]

    def linked(a, b):
        x, y = pairs[a][1], pairs[b][1]
        return ok[a] and ok[b] and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95 - 1e-12

    n = [sum(linked(a, b) for b in range(len(pairs)) if a != b) for a in range(len(pairs))]
    least = classes(pairs, linked)
    table = spark.createDataFrame([(i, v, "clash") for i, v in pairs], "vec_id long, embedding array<double>, key string")
    got = embedding_dedup(table).collect()
    found, true = sum(x.n_links for x in got), sum(n)
    assert 0.97 * true <= found <= true
    if found == true:
        assert sorted((repr(x.vec_id), x.n_links, repr(x.component_id)) for x in got) == sorted((repr(pairs[k][0]), n[k], repr(pairs[least[k]][0])) for k in range(len(pairs)))
        assert sum(x.kept for x in got) == len(set(least))
    assert embedding_dedup(table.limit(0)).count() == 0


def test_dense_groups_are_counted_in_lots(spark, monkeypatch):
    from lexiquarry.llm import embedding_dedup as module

    r = np.random.default_rng(8)
    centre = r.standard_normal((3, 32))
    x = np.concatenate([centre[0] + 0.12 * r.standard_normal((90, 32)), centre[1] + 0.2 * r.standard_normal((60, 32)), centre[2] + 0.02 * r.standard_normal((40, 32)), r.standard_normal((50, 32))])
    x[200] = x[3]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    least = classes([(k, None) for k in range(len(x))], lambda a, b: linked[a, b])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    for few, block in ((module.FEW, module.BLOCK), (3, 7)):
        monkeypatch.setattr(module, "FEW", few)
        monkeypatch.setattr(module, "BLOCK", block)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(table).collect()}
        missed = sum(linked[k].sum() - got[k][0] for k in got)
        assert 0 <= missed <= 0.01 * linked.sum()
        assert all(got[k][0] <= linked[k].sum() for k in got)
        if not missed:
            assert [got[k][1] for k in range(len(x))] == least


def at_threshold(n, dims, mean, seed, cosine=0.95):
    """Unit vectors whose mean has this squared length, and others at the cosine from them."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims))
    x[:, 0] = 0
    x *= (1 - mean) ** 0.5 / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] = mean**0.5
    away = r.standard_normal((n, dims))
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    return x, cosine * x + (1 - cosine**2) ** 0.5 * away / np.linalg.norm(away, axis=1, keepdims=True)


def hits(how, a, b):
    """Which pairs meet in a table, and which pass the cutoff."""
    apart = encode(a, how.mean, how.projection) != encode(b, how.mean, how.projection)
    parts = apart[:, : how.width * how.tables].reshape(len(a), how.tables, how.width)
    return (parts.sum(2) <= 1).any(1), apart[:, : how.coded].sum(1) <= how.most


def test_tables_find_pairs_at_the_threshold_at_any_size():
    x, _ = at_threshold(8000, 64, 0.0, 1)
    a, b = at_threshold(4000, 64, 0.0, 2)
    for n in (10_000, 1_000_000, 100_000_000):
        met, near = hits(fit(x, n, 0.95), a, b)
        assert (met & near).mean() > 0.99


@pytest.mark.parametrize("dims", [64, 256])
def test_tables_allow_for_a_common_mean(dims):
    how = fit(at_threshold(8000, dims, 0.7, 1)[0], 100_000, 0.95)
    met, near = hits(how, *at_threshold(4000, dims, 0.7, 2))
    assert near.mean() > 0.999 and (met & near).mean() > 0.99


def test_embedding_dedup_with_a_common_mean(spark):
    x, y = at_threshold(600, 96, 0.7, 5, 0.951)
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])]
    n = sum(r.n_links for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    v = np.concatenate([x, y])
    true = ((v @ v.T >= 0.95).sum() - len(v)).item()
    assert 0.99 * true <= n <= true


def test_kneser_ney_query_trains_order_3(spark, monkeypatch):
    from lexiquarry.llm import queries

    models, real = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda *a: models.append(real(*a)) or models[-1])
    queries.op1_kneser_ney(spark, "/root/testdata/sf0.001")
    assert [m.order for m in models] == [3]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney(rows, order):
    r = random.Random(order)
    docs = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 40)))) for k in range(60)] + [(98, None), (99, ""), (5, "a a b")]
    test = [*docs[:10], (200, "zz a B unseen\tb"), (201, None)]
    seqs = [WORD.findall(lower(t)) + ["\0"] for _, t in docs]
    grams = collections.Counter(tuple(p[k : k + order]) for s in seqs for p in [["<s>"] * (order - 1) + s] for k in range(len(s)))
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = collections.Counter()
        for g, n in levels[k + 1].items():
            levels[k][g[1:]] += n if k > 1 and g[1] == "<s>" else 1
    unigrams = collections.Counter(w for s in seqs for w in s)
    v, total = len(unigrams), sum(unigrams.values())
    d = {k: kneser_ney.discounts([sum(1 for n in c.values() if n == m) for m in (1, 2, 3, 4)]) for k, c in levels.items()}
    context = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            x = context[k][g[:-1]]
            x[0] += n
            x[min(n, 3)] += 1

    def p(g):
        k = len(g)
        if not k:
            return 1 / (v + 1)
        lower_p = p(g[1:])
        x = context[k].get(g[:-1])
        if not x:
            return lower_p
        n = levels[k].get(g, 0)
        return max(n - d[k][min(n, 3)], 0) / x[0] + sum(d[k][m] * x[m] for m in (1, 2, 3)) / x[0] * lower_p

    known = list(unigrams)
    assert abs(sum(p((*["<s>"] * (order - 1), w)) for w in known) + p((*["<s>"] * (order - 1), "??")) - 1) < 1e-9
    model = kneser_ney.train(rows(docs), order)
    assert (model.n_tokens, model.n_words) == (total, v)
    got = {x.row.doc_id: x for x in kneser_ney.score(rows(test), model).collect()}
    for i, t in test:
        s = WORD.findall(lower(t)) + ["\0"]
        padded = ["<s>"] * (order - 1) + s
        x = got[i]
        assert (x.n_tokens, x.n_known) == (len(s), sum(w in unigrams for w in s))
        assert math.isclose(x.base_score, sum(math.log10((unigrams.get(w, 0) + 0.5) / (total + 0.5 * (v + 1))) for w in s), rel_tol=1e-9)
        assert math.isclose(x.score, sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(s))), rel_tol=1e-4)


def test_words_of_equal_build_differ(rows, thue_morse):
    a, b = thue_morse
    got = kneser_ney.score(rows([(1, a), (2, b)]), kneser_ney.train(rows([(1, a)]), 2)).collect()
    assert {r.row.doc_id: r.n_known for r in got} == {1: 2, 2: 1}
    x, y = " ".join(a * 4), " ".join(b * 4)
    pairs = [(1, a), (2, b), (3, x.replace("b", "c")), (4, y.replace("b", "c"))]
    got = {r.doc_id: r.copy_of for r in near_dedup(rows(pairs)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_kneser_ney_without_training_texts(rows):
    model = kneser_ney.train(rows([]), 3)
    got = kneser_ney.score(rows([(1, "a b"), (2, None)]), model).collect()
    assert {r.row.doc_id: (r.n_tokens, r.n_known, r.score) for r in got} == {1: (3, 0, 0.0), 2: (1, 0, 0.0)}


def test_frequent_contexts_are_summed_over_parts(rows, monkeypatch):
    r = random.Random(1)
    docs = rows([(k, " ".join(r.choice("abcdef") for _ in range(50))) for k in range(40)])
    want = {x.row.doc_id: x.score for x in kneser_ney.score(docs, kneser_ney.train(docs, 3)).collect()}
    monkeypatch.setattr(kneser_ney, "OFTEN", 330)
    model = kneser_ney.train(docs, 3)
    assert sum(model.store.sizes["C2"]) and sum(model.store.sizes["c3"])
    got = {x.row.doc_id: x.score for x in kneser_ney.score(docs, model).collect()}
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
