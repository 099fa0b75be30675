"""Operators that work row by row: BPE, language ID, decontamination, HTML."""

import array
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from lexiquarry.llm.bpe import Tokenizer, bpe
from lexiquarry.llm.decontaminate import decontaminate
from lexiquarry.llm.html_blocks import blocks
from lexiquarry.llm.html_extract import extract
from lexiquarry.llm.language_id import identify, train
from lexiquarry.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "aaaaaaaaaaaaaaaaaaaaaaaa", "ttttttt    ", "x<|endoftext|>y", "<|endoftext|><|", "l'été 123½ \r\n\t end", "\x1c\x85", "՘\U000323b1", "日本語 😀́", "ab" * 3000]


def test_automaton_encodes_as_the_library():
    mine, library = Tokenizer(PATH), Library.from_file(PATH)
    r = random.Random(5)
    some = ODD + ["".join(r.choice("etaoin shrdluE.,'<|>\n é1") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    some += ["".join(chr(r.choice([r.randrange(32, 0x300), r.randrange(0x300, 0xD800), r.randrange(0xE000, 0x30000)])) for _ in range(20)) for _ in range(300)]
    for t in some:
        ids = mine.ids(t)
        assert list(array.array("I", ids)) == library.encode(t, add_special_tokens=False).ids, t
        assert mine.text(ids) == t


def test_automaton_starts_its_table_anew(monkeypatch):
    from lexiquarry.llm import bpe as module

    mine, library = Tokenizer(PATH), Library.from_file(PATH)
    monkeypatch.setattr(module, "KEPT_STATES", 50)
    for k in range(300):
        t = f"word{k * 7919}ing and more"
        assert list(array.array("I", mine.ids(t))) == library.encode(t, add_special_tokens=False).ids


def test_files_that_are_not_supported(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    (tmp_path / "lstrip.json").write_text(json.dumps(spec | {"added_tokens": [t | {"lstrip": True} for t in spec["added_tokens"]]}))
    few = {t: i for t, i in spec["model"]["vocab"].items() if t != "!"}
    (tmp_path / "few.json").write_text(json.dumps(spec | {"model": spec["model"] | {"vocab": few, "merges": []}}))
    for name in ("lstrip", "few"):
        with pytest.raises(ValueError, match=name):
            Tokenizer(f"{tmp_path}/{name}.json")


def test_bpe_and_counts(spark, rows, tmp_path):
    docs = rows([(k, t) for k, t in enumerate(ODD)] + [(None, None), (3, "same"), (3, "same")])
    library = Library.from_file(PATH)
    expected = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in [*ODD, None, "same", "same"])
    got = bpe(docs, PATH).collect()
    assert sorted((len((r.row.text or "").encode()), r.n_tokens) for r in got) == expected
    assert all(r.decoded == (r.row.text or "") for r in got)
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        assert sorted((r.n_bytes, r.n_tokens) for r in token_counts(docs, PATH, cache).collect()) == expected
    assert spark.read.parquet(cache).count() == len({t or "" for t in [*ODD, None, "same"]})
    assert token_counts(rows([]), PATH).count() == 0 == bpe(rows([]), PATH).count()


def test_language_id(rows):
    r = random.Random(2)
    words = {"en": "the of and to in is that for was with".split(), "de": "der die und das nicht ist für mit über auch".split(), "fr": "le la les des est une que pour où été".split()}
    make = lambda k: " ".join(r.choice(words[k]) for _ in range(30))
    docs = [(i, make(k), k) for i, k in enumerate(["en", "de", "fr"] * 40)]
    spark = rows([]).sparkSession
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = train(table, per_class=20)
    test = spark.createDataFrame([(1, make("en"), "en"), (2, make("de"), "de"), (3, make("fr"), "fr"), (4, None, "und"), (5, "12 !?", "und"), (6, "", "und")], "doc_id long, text string, lang string")
    for x in identify(test, model).collect():
        assert x.lang_pred == x.row.lang and 0 <= x.score <= 1
    assert {x.lang_pred for x in identify(test, train(table.limit(0))).collect()} == {"und"}
    assert identify(test.limit(0), model).count() == 0


def test_kernels_by_brute_force(rows, monkeypatch):
    import numpy as np

    from lexiquarry.llm import language_id

    r = random.Random(6)
    docs = [(k, "".join(r.choice("abcé ") for _ in range(r.choice([1, 2, 5, 80]))) + "x", "pq"[k % 2]) for k in range(30)]
    spark = rows([]).sparkSession
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = train(table, per_class=9, landmarks=8)
    marks = [t.encode() for _, t in language_id.sample(table, "lang", 9, 10)]
    marks = [*marks[:4], *marks[9:13]]
    grams = lambda b: {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}
    known = set().union(*(grams(t.encode()) for _, t in language_id.sample(table, "lang", 9, 10)))
    texts = [t.encode() for _, t, _ in docs] + [b"", b"ab" * 40000, b"a"]
    off, data = np.concatenate([[0], np.cumsum([len(t) for t in texts])]), np.frombuffer(b"".join(texts), np.uint8)
    want = np.array([[len(grams(t) & grams(m)) / (max(1, len(grams(t) & known)) * len(grams(m))) ** 0.5 for m in marks] for t in texts])
    for piece in (language_id.PIECE, 1000):
        monkeypatch.setattr(language_id, "PIECE", piece)
        p = model.presence(off, data)
        assert len(model.grams.codes) == len(known) + 1
        assert np.allclose(model.kernel(p), want, atol=1e-5)
        assert np.allclose(model.scores(off, data), want @ model.coefficients, atol=1e-3)
    same = spark.createDataFrame([(k, "abc", "z") for k in range(3)], "doc_id long, text string, lang string")
    assert {(x.lang_pred, x.score) for x in identify(same, train(same)).collect()} == {("z", 1.0)}
    assert len({(x.lang_pred, x.score) for x in identify(same, model).collect()}) == 1
    with pytest.raises(ValueError):
        train(table, classes=1)


def test_decontaminate(spark, rows, monkeypatch):
    item = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    bench = [(1, "One two three four five six seven eight nine ten eleven twelve"), (10, "short item"), (2, None), (3, "..."), (None, "lone words here"), (1, "One two three four five six seven eight nine ten eleven twelve")]
    docs = [(1, "x ONE-two three four five six seven eight nine ten y"), (2, "a short; item b short item"), (3, None), (4, ""), (5, "nothing"), (6, "lone words here"), (7, "two three four five six seven eight nine ten eleven twelve " * 50), (7, "short")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    expected = []
    for i, t in docs:
        w, hit, items = item.findall((t or "").lower()), set(), set()
        for k, b in bench:
            v = item.findall((b or "").lower())
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        items |= {str(k)} if k is not None else set()
        expected.append((i, len(w), len(hit), sorted(items)))
    got = [(r.row.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(rows(docs), table).collect()]
    assert sorted(got) == sorted(expected)
    from lexiquarry.llm import decontaminate as module

    monkeypatch.setattr(module, "BLOCK", 7)
    monkeypatch.setattr(module, "PIECE", 2)
    got = [(r.row.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(rows(docs), table).collect()]
    assert sorted(got) == sorted(expected)
    assert all(r.n_hit == 0 for r in decontaminate(rows(docs), table.limit(0)).collect())
    assert decontaminate(rows([]), table).count() == 0


def test_blocks():
    page = '<body><nav><a href="/x">Home</a></nav><script>var t="</p>";</script><!-- <p>no</p> --><p><b>Title &amp; more<br>x<p>Next&nbsp;one</p><ul><li>a<li>b</ul>tail'
    assert [b.text for b in blocks(page)] == ["Home", "Title & more x", "Next one", "a", "b", "tail"]


@pytest.mark.parametrize("page, texts", [("<p>one</p><svg/><p>two</p>", ["one", "two"]), ("<p>one</p><iframe src=x /><p>two</p>", ["one", "two"]), ("<p>one</p><!--><p>two</p>", ["one", "two"]), ("<p>one</p><svg><path d='M0'><p>two", ["one", "two"]), ("<p>E = <math><mi>m</mi><mo>c</mo></math></p><noscript>shown</noscript>", ["E = mc", "shown"]), ("<p>1 < 2 <a title='a>b'>l</a></p", ["1 < 2 l</p"]), ("<style>x</style><p>a<script>b</p></script>c", ["ac"]), ("<title>t</title><textarea>u", ["t", "u"]), ("", []), ("<", ["<"])])
def test_nothing_is_lost(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_broken_pages_take_linear_time():
    import time

    for unit in ("<div>x", "<a b ", '<a x="', "<ul><li>x", "<span>y<hr>", "x</q>", "<title>", "a" * 9):
        began = time.time()
        blocks("<" + unit * (2_000_000 // len(unit)))
        assert time.time() - began < 20, unit


def test_long_pages_are_labelled_as_short_ones():
    import numpy as np

    from lexiquarry.llm.block_tagger import Maker, Tagger, padded

    tagger, maker = Tagger(seed=3), Maker(5)
    some = [maker.example()[0] for _ in range(6)]
    x, mask, _ = padded([(f, np.zeros(len(f), np.float32)) for f in some])
    together = tagger.scores(x, mask)
    a, _ = tagger.forward.run(x, mask)
    b, _ = tagger.backward.run(x[::-1], mask[::-1])
    plain = 1 / (1 + np.exp(-(np.concatenate([a, b[::-1]], 2) @ tagger.v + tagger.v0)))[:, :, 0]
    for k, f in enumerate(some):
        alone = tagger.long_scores(lambda lo, hi, f=f: f[lo:hi], len(f), 5)
        assert np.allclose(alone, together[: len(f), k], atol=1e-5) and np.allclose(alone, plain[: len(f), k], atol=1e-5)


def test_blocks_of_pages_of_other_makes():
    from labelled_pages import PAGES

    from lexiquarry.llm.block_tagger import trained
    from lexiquarry.llm.html_extract import main_texts

    right = total = 0
    got = main_texts(trained(), [page.replace("§", "") for page in PAGES.values()])
    for page, kept in zip(PAGES.values(), got):
        found = [b.text for b in blocks(page)]
        total += len(found)
        right += sum(("§" in t) == (t.replace("§", "") in kept) for t in found)
    assert right / total > 0.85


def test_extract(spark):
    filler = "Words that make an article of some length and say a little."
    page = f'<html><head><title>t</title></head><body><header class="site-header">Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now</div><article><h1>A title here</h1><p>{filler}</p><p>{filler} &copy; x</p></article><section class="comments"><div class="comment"><p>Great post!</p></div></section><aside class="sidebar">Most read</aside><form class="search"><label>Email</label></form><footer>&copy; legal</footer></body></html>'
    got = extract(spark.createDataFrame([(1, page), (2, None), (3, ""), (4, page)], "page_id long, html string")).collect()
    text = f"A title here\n\n{filler}\n\n{filler} © x"
    assert {r.row.page_id: r.text for r in got} == {1: text, 2: "", 3: "", 4: text}
    assert hashlib.md5(b"").hexdigest() and zlib.crc32(b"") == 0
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_gradients(seed):
    import numpy as np

    from lexiquarry.llm.block_tagger import Tagger

    rng = np.random.default_rng(seed)
    t = Tagger(inputs=5, hidden=3, seed=seed)
    for layer in (t.forward, t.backward):
        layer.wx, layer.wh, layer.b = (p.astype(np.float64) for p in (layer.wx, layer.wh, layer.b))
    t.v = t.v.astype(np.float64)
    x, mask = rng.standard_normal((4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = rng.integers(0, 2, (4, 2)).astype(float)
    _, grads = t.gradients(x, mask, y)
    for p, g in zip(t.parameters(), grads):
        k = tuple(rng.integers(0, n) for n in p.shape)
        old = p[k]
        p[k] = old + 1e-3
        up = t.gradients(x, mask, y)[0]
        p[k] = old - 1e-3
        down = t.gradients(x, mask, y)[0]
        p[k] = old
        assert abs((up - down) / 2e-3 - g[k]) < 2e-3
