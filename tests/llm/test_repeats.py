"""Repeated windows and substrings against brute force; null, empty, repeated and long texts."""

import random
import re

import pytest

from lexiquarry.llm.substring_dedup import substring_dedup
from lexiquarry.llm import suffix_dedup as suffixes
from lexiquarry.llm.suffix_dedup import suffix_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def texts(seed):
    r = random.Random(seed)
    base = [" ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 120))) for _ in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    for k in range(30):
        t = r.choice(base)
        cut = r.randint(0, len(t))
        out.append((100 + k, r.choice([t, t[cut:] + " x " + t[:cut], r.choice(base)[: r.randint(0, 300)] + t[cut:], t.replace("a", "z", 1), "\t".join(t.split())])))
    out += [(500, None), (501, ""), (502, "  "), (503, "a" * 700), (504, "ab " * 300), (None, base[0]), (505, base[1]), (505, base[1]), (505, base[2])]
    r.shuffle(out)
    return out


def in_order(pairs):
    return sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, (p[1] or "").encode()))


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(rows, seed):
    pairs = texts(seed)
    expected, seen = [], set()
    for i, t in in_order(pairs):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        expected.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(rows(pairs)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("start", [None, 20])
def test_suffix_dedup(rows, start):
    pairs = texts(3)
    expected, seen = [], set()
    for i, t in in_order(pairs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            key = b[k : k + 100]
            if key in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(key)
        expected.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix_dedup(rows(pairs), **({"start": start} if start else {})).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_suffix_dedup_doubles(rows, monkeypatch):
    rounds, real = [], suffixes._double
    monkeypatch.setattr(suffixes, "_double", lambda step, parts: rounds.append(step) or real(step, parts))
    suffix_dedup(rows(texts(4)))
    assert rounds == [32, 36] and suffixes.doublings(100, 16) == [16, 32, 36]


def test_words_of_equal_build_differ(rows, thue_morse):
    head = " ".join(f"w{k}" for k in range(19))
    got = substring_dedup(rows([(k, f"{head} {w}") for k, w in enumerate(thue_morse)])).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(20, 0)] * 2


def test_empty_tables(rows):
    assert substring_dedup(rows([])).count() == 0
    assert suffix_dedup(rows([])).count() == 0
