"""The columns of the queries, by brute force over a small table with nulls, repeats and odd texts."""

import array
import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from lexiquarry.llm.queries import QUERIES

LIBRARY = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = {"en": "the of and to in is that for was with", "de": "der die und das nicht ist für mit über auch", "fr": "le la les des est une que pour où été"}


def make():
    out = []
    for k in range(90):
        lang = ["en", "de", "fr"][k % 3]
        w = WORDS[lang].split()
        out.append((k, " ".join(w[(k * j + j * j) % 10] for j in range(1, 40)), lang if k % 7 else None))
    return out + [(200, None, "en"), (201, "", "de"), (202, "12 !?", None), (203, "a" * 512, None), (204, "!a" * 256, "en"), (205, "!a" * 256 + "!", "en"), (None, "the null of ids", "en"), (3, "The 3 again", "en"), (3, "The 3 again", "en")]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("contract"))
    rows = make()
    spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, n_tokens string, row int").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def crc(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def bag(rows):
    return sorted(rows, key=repr)


def test_op1(spark, table):
    folder, rows = table
    tokens = lambda t: [*WORD.findall((t or "").lower()), "\0"]
    seen = collections.Counter(w for i, t, _ in rows if crc(i, 5) != 1 for w in tokens(t))
    total, v = sum(seen.values()), len(seen)
    expected = bag((i, crc(i, 5) == 1, len(tokens(t)), sum(w in seen for w in tokens(t)), total, round(sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, _ in rows)
    got = QUERIES["op1_kneser_ney"](spark, folder).collect()
    assert bag((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_op3(spark, table):
    folder, rows = table

    def digests(t):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = QUERIES["op3_bpe_automaton"](spark, folder).collect()
    assert bag((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == bag((i, *digests(t)) for i, t, _ in rows)


def test_op4(spark, table):
    folder, rows = table
    got = QUERIES["op4_string_kernel"](spark, folder).collect()
    assert bag((r.doc_id, r.held_out) for r in got) == bag((i, crc(i, 3) == 1) for i, _, _ in rows)
    said = {r.doc_id: r for r in got}
    assert all(said[k].lang_pred == ["en", "de", "fr"][k % 3] for k in range(90) if k != 3)
    assert {said[k].lang_pred for k in (200, 201, 202)} == {"und"} and all(0 <= r.score <= 1 for r in got)


def test_op7(spark, table):
    folder, rows = table
    n = lambda t: len(LIBRARY.encode(t or "", add_special_tokens=False).ids)
    got = QUERIES["op7_digest_cache"](spark, folder).collect()
    assert bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == bag((i, len((t or "").encode()), n(t), n(t) > 512) for i, t, _ in rows)
    assert {n(rows[k][1]) for k in (94, 95)} == {512, 513}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_kneser_ney", "op3_bpe_automaton", "op4_string_kernel", "op5_suffix_array", "op6_rabin_karp", "op7_digest_cache", "op10_bagminhash"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
