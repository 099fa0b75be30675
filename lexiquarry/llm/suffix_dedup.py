"""Suffix-array dedup: distributed prefix doubling over the positions whose windows can repeat.

Sorting a row for each byte would move the corpus some forty times. So first a proven filter, then the doubling:

1.  Runs. Each ``threshold``-byte window has an anchor: its ``ANCHOR``-byte substring of least hash. Consecutive
    windows with the same anchor are a run, about one for 27 bytes. Equal windows have equal anchors, so a run whose
    anchor is unique in the corpus holds no repeated window and drops out. Runs of equal bytes have equal ranks at all
    of their positions, so the first of them carries the ranks of all; the others repeat it as a whole. Where an anchor
    occurs in different surroundings, only ranks can tell which of the windows are equal.
2.  Positions. A position's rank is at first a 64-bit code of its next h = ``start`` bytes (as the plain method starts
    from the codes of single characters). Round by round the pairs (rank at p, rank at p + h) are sorted over all parts
    and reranked, h doubling, until positions are unique (they drop out) or the prefix reaches ``threshold``: 16, 32, 64,
    100 bytes. Positions that still share a rank are repeats, but the first.

Each sort is dealt by hash of the pair over parts of bounded size. Every task sends one entry for each distinct key it
holds, so a string that a third of the documents share doesn't gather in a part. Each round is staged and frees the
shuffle files and the table of the round before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed
from .common import BASES, BYTE_VALUES, Rolling, Sized, binary, by_part, deal, doc_id_array, expand, first_of, free, gathered, mix, pack, squeeze, squeezed_texts, staged, tune, unpack, unsqueezed, word_hashes
from .packed import DONE, FORCED, OPEN, RANK, STATE, TEXT

PART_BYTES = 8 << 20
ANCHOR = 48
PIECE = 1 << 18
#: Different surroundings of one anchor that a task sends to the anchor's part; further ones go to parts of their own.
SURROUNDINGS = 64
OUT = "doc_id long, sub long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept {}"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_INDEX = np.uint64((1 << 20) - 1)


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive values."""
    have = 1
    while have * 2 <= n:
        v = np.minimum(v[: len(v) - have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (n - have)], v[n - have :]) if have < n else v


def runs(data: np.ndarray, off: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
    """(start, number of windows, anchor hash, hash of all bytes) of each run of windows that share an anchor."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, len(data) - w + 1), PIECE):
        seg = data[lo : lo + PIECE + w - 1]
        m = len(seg) - w + 1
        values = BYTE_VALUES[seg]
        kh = mix(Rolling(values, BASES[0]).windows(ANCHOR))
        mm = sliding_min((kh & ~_INDEX) | np.arange(len(kh), dtype=np.uint64), w - ANCHOR + 1) & _INDEX
        d0, d1 = np.searchsorted(off, [lo, lo + m - 1], "right") - 1
        edges = np.clip(off[d0 : d1 + 2] - lo, 0, m)
        doc = np.repeat(np.arange(d0, d1 + 1), np.diff(edges))
        valid = np.arange(lo + w, lo + w + m) <= off[doc + 1]
        new = np.ones(m, bool)
        new[1:] = (mm[1:] != mm[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new & valid)
        if not len(at):
            continue
        total = np.cumsum(valid)
        n = np.diff(np.append(total[at] - 1, total[-1]))
        context = word_hashes(seg, at, at + n + w - 1)
        out.append((at + lo, n, kh[mm[at].astype(np.int64)], mix(context ^ mix(n.astype(np.uint64)))))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _sampled(w: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            rows = packed.Rows()
            ids, subs = b.column("id").to_numpy(), b.column("sub").to_numpy()
            off, data = binary(b.column("text"))
            at, n, anchor, context = runs(data, off, w)
            if not len(at):
                continue
            doc = np.searchsorted(off, at, "right") - 1
            pos = at - off[doc]
            with np.errstate(over="ignore"):
                first = first_of(anchor * np.uint64(BASES[1]) + context)
            again = np.flatnonzero(~first)
            packed.send(rows, DONE, ids, subs, doc[again], pos[again], parts, nums=n[again].astype(np.uint16))
            keep = np.flatnonzero(first)
            doc, pos, n, anchor, context = (x[keep] for x in (doc, pos, n, anchor, context))
            o, new = packed.groups((anchor,), np.arange(len(anchor)))
            nth = np.empty(len(o), np.int64)
            nth[o] = np.arange(len(o)) - np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
            many = nth >= SURROUNDINGS
            part = (np.where(many, mix(context), mix(anchor)) % np.uint64(parts)).astype(np.int64)
            for p, i in by_part(part + many * parts):
                rows.add(p % parts, FORCED if p >= parts else OPEN, pack(ids, subs, doc[i], pos[i]), anchor[i].tobytes(), context[i].tobytes(), squeeze(n[i].astype(np.uint16)))
            yield from rows.batches()

    return run


def _ranked_runs(parts: int):
    """DONE: runs that repeat an earlier one. OPEN: first runs of a class whose anchor has other surroundings too."""

    def run(table: pa.Table) -> pa.Table:
        rows = packed.Rows()
        kinds = packed.split_kinds(table)
        for r in kinds.get(DONE, []):
            rows.add(r["part"], DONE, r["data"], nums=r["nums"])
        for kind in (OPEN, FORCED):
            if not (found := kinds.get(kind)):
                continue
            p = packed.Positions([r["data"] for r in found])
            anchor, context = packed.raw([r["key"] for r in found]), packed.raw([r["aux"] for r in found])
            n = packed.nums_of(found)
            o, new = packed.groups((anchor, context), p.order)
            later, firsts = o[~new], o[new]
            packed.send(rows, DONE, p.ids, p.subs, p.doc[later], p.pos[later], parts, nums=n[later])
            if kind == OPEN:
                a = anchor[firsts]
                same = np.zeros(len(a), bool)
                same[1:] = a[1:] == a[:-1]
                same[:-1] |= same[1:]
                firsts = firsts[same]
            packed.send(rows, OPEN, p.ids, p.subs, p.doc[firsts], p.pos[firsts], parts, nums=n[firsts])
        return rows.table()

    return run


def _send_distinct(rows: packed.Rows, part: int, ids, subs, doc, pos, key: np.ndarray, aux: np.ndarray, parts: int) -> None:
    """Sends the first position of each distinct (key, aux) to be ranked, and all positions to the same part as state."""
    if not len(pos):
        return
    order = (doc.astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64)
    o, new = packed.groups((key, aux), order)
    size = np.diff(np.append(np.flatnonzero(new), len(o)))
    lead = o[new]
    leader = np.empty(len(o), np.int64)
    leader[o] = np.repeat(lead, size)
    rows.add(part, STATE, pack(ids, subs, doc, pos), key=squeeze(leader.astype(np.int64) - np.arange(len(o))))
    several = np.zeros(len(pos), bool)
    several[lead] = size > 1
    lead = np.sort(lead)
    for p, i in by_part((aux[lead] % np.uint64(parts)).astype(np.int64)):
        i = lead[i]
        rows.add(p, OPEN, pack(ids, subs, doc[i], pos[i]), key[i].tobytes(), None, squeeze(several[i]))


def _pairs(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(a + np.uint64(seed)) * np.uint64(BASES[1]) + b)


def _codes(data: np.ndarray, at: np.ndarray, h: int) -> np.ndarray:
    """A 64-bit code of the ``h`` (8 at least) bytes at each place."""
    lanes = np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), strides=(1,))
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, h - 8, 8), h - 8]:
        out = _pairs(out, lanes[at + k], k)
    return out


def _prefixes(w: int, h: int, step: int, parts: int):
    """The first pairs: codes of h bytes at p and at p + step, for each position p that a round may ask for."""

    def run(table: pa.Table) -> pa.Table:
        rows = packed.Rows()
        kinds = packed.split_kinds(table)
        wanted = {k: (pos, n) for k, pos, n in packed.per_document(kinds.get(OPEN, []))}
        found: list[tuple] = []
        for r in sorted((r for r in kinds.get(TEXT, []) if (r["id"], r["sub"]) in wanted), key=lambda r: (r["id"], r["sub"])):
            data = np.frombuffer(unsqueezed(r["data"]), np.uint8)
            pos, n = wanted[r["id"], r["sub"]]
            at = np.flatnonzero(packed.covered(len(data), pos, pos + n.astype(np.int64) + w - h - step))
            key, aux = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
            for lo in range(0, len(data), PIECE):
                i = slice(*np.searchsorted(at, [lo, lo + PIECE]))
                seg, a = data[lo : lo + PIECE + h + step], at[i] - lo
                x, y = _codes(seg, a, h), _codes(seg, a + step, h)
                for out, base in ((key, BASES[0]), (aux, BASES[1])):
                    out[i] = _pairs(x, y, base)
            found.append((r["id"], r["sub"], at, key, aux))
        if found:
            doc = np.repeat(np.arange(len(found)), [len(f[2]) for f in found])
            part = table.column("part")[0].as_py()
            _send_distinct(rows, part, *(np.array([f[k] for f in found], np.int64) for k in (0, 1)), doc, *(np.concatenate([f[k] for f in found]) for k in (2, 3, 4)), parts)
        return rows.table()

    return run


def _rank(parts: int):
    """Sorts the keys of a part and gives each key that isn't unique a rank; STATE rows pass through."""

    def run(table: pa.Table) -> pa.Table:
        rows = packed.Rows()
        kinds = packed.split_kinds(table)
        for r in kinds.get(STATE, []):
            rows.add(r["part"], STATE, r["data"], r["key"])
        if found := kinds.get(OPEN):
            p = packed.Positions([r["data"] for r in found])
            key = packed.raw([r["key"] for r in found])
            several = packed.nums_of(found, bool)
            o, new = packed.groups((key,), p.order)
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(o)))
            repeated = np.repeat((size > 1) | np.logical_or.reduceat(several[o], at), size)
            rank = (np.repeat(np.arange(1, len(at) + 1), size).astype(np.uint64) << np.uint64(1)) | new.astype(np.uint64)
            with np.errstate(over="ignore"):
                rank |= np.uint64(found[0]["part"]) << np.uint64(32)
            o, rank = o[repeated], rank[repeated]
            packed.send(rows, RANK, p.ids, p.subs, p.doc[o], p.pos[o], parts, key=rank)
        return rows.table()

    return run


def _ranks(kinds: dict[int, list[dict]]):
    """(ids, subs, doc, pos, rank, is the first of all) of the positions whose rank isn't unique."""
    if not kinds.get(STATE) or not kinds.get(RANK):
        return None
    state = [unpack(r["data"]) for r in kinds[STATE]]
    ranks = packed.Positions([r["data"] for r in kinds[RANK]] + [r["data"] for r in kinds[STATE]])
    n = sum(ranks.sizes[: len(kinds[RANK])])
    order = ranks.order
    o = np.argsort(order[:n])
    known, rank = order[:n][o], np.concatenate([expand(r["key"], np.uint64) for r in kinds[RANK]])[o]
    leads, base = [], n
    for r, s in zip(kinds[STATE], state, strict=True):
        leads.append(base + np.arange(len(s[3])) + expand(r["key"], np.int64))
        base += len(s[3])
    mine, lead = np.arange(n, base), np.concatenate(leads)
    at = np.minimum(np.searchsorted(known, order[lead]), n - 1)
    hit = known[at] == order[lead]
    mine, at, first = mine[hit], at[hit], (mine == lead)[hit]
    o = np.argsort(order[mine])
    mine, at, first = mine[o], at[o], first[o]
    return ranks.ids, ranks.subs, ranks.doc[mine], ranks.pos[mine], rank[at] >> np.uint64(1), first & ((rank[at] & np.uint64(1)) == 1)


def _double(step: int, parts: int):
    """The next keys: pairs of the ranks at p and p + step."""

    def run(table: pa.Table) -> pa.Table:
        rows = packed.Rows()
        if got := _ranks(packed.split_kinds(table)):
            ids, subs, doc, pos, rank, _ = got
            order = (doc.astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64)
            at = np.minimum(np.searchsorted(order, order + np.uint64(step)), len(order) - 1)
            ok = np.flatnonzero(order[at] == order + np.uint64(step))
            _send_distinct(rows, table.column("part")[0].as_py(), ids, subs, doc[ok], pos[ok], *(_pairs(rank[ok], rank[at[ok]], b) for b in BASES), parts)
        return rows.table()

    return run


def _repeats(parts: int):
    """DONE: the positions that aren't the first of their rank."""

    def run(table: pa.Table) -> pa.Table:
        rows = packed.Rows()
        if got := _ranks(packed.split_kinds(table)):
            ids, subs, doc, pos, _, first = got
            i = np.flatnonzero(~first)
            packed.send(rows, DONE, ids, subs, doc[i], pos[i], parts, nums=np.ones(len(i), np.uint16))
        return rows.table()

    return run


def _cut(w: int, as_text: bool):
    def run(table: pa.Table) -> pa.Table:
        kinds = packed.split_kinds(table)
        repeats = {k: (pos, n) for k, pos, n in packed.per_document(kinds.get(DONE, []))}
        out: list[list] = [[] for _ in range(6)]
        for r in kinds.get(TEXT, []):
            raw = unsqueezed(r["data"])
            got = repeats.get((r["id"], r["sub"]))
            if got is None:
                new = (r["id"], r["sub"], len(raw), 0, [], raw)
            else:
                gone = packed.covered(len(raw), got[0], got[0] + got[1].astype(np.int64) + w - 1)
                new = (r["id"], r["sub"], len(raw), int(gone.sum()), packed.spans(gone), np.frombuffer(raw, np.uint8)[~gone].tobytes())
            for c, v in zip(out, new, strict=True):
                c.append(v)
        return pa.table({"doc_id": doc_id_array(np.array(out[0], np.int64)), "sub": pa.array(out[1], pa.int64()), "n_bytes": pa.array(out[2], pa.int64()), "n_removed": pa.array(out[3], pa.int64()), "spans": pa.array(out[4], _SPANS), "kept": pa.array([k.decode("utf-8", "ignore") for k in out[5]], pa.string()) if as_text else pa.array(out[5], pa.binary())})

    return run


def doublings(threshold: int, start: int) -> list[int]:
    """The offsets of the rounds: each doubles the prefix, the last one fills it up."""
    h, out = start, []
    while h < threshold:
        out.append(min(h, threshold - h))
        h += out[-1]
    return out


def suffix_dedup(docs: DataFrame, threshold: int = 100, start: int = 16, as_text: bool = False) -> DataFrame:
    """Removes each byte covered by a ``threshold``-byte string that also starts earlier.

    Earlier: in a smaller doc_id, or before it in the same document; overlaps count. Texts are UTF-8 bytes, matches
    never cross documents and are judged on the input. ``threshold`` is at least 64; ``start`` (8 at least, half
    of it at most) is the first prefix length of the doubling. Returns doc_id, sub (0; numbers rows that share a doc_id), n_bytes,
    n_removed, spans (maximal removed runs of bytes, [start, end)) and kept (binary, as a cut may split a
    character; with ``as_text`` a string without such broken characters).

    Null or empty text: no bytes. Null doc_id: sorts before all others. Rows that share a doc_id are documents of
    their own, in order of their texts. An empty table gives no rows; extra columns are ignored.
    """
    if threshold < ANCHOR + 16:
        raise ValueError(f"threshold must be at least {ANCHOR + 16}")
    if not 8 <= start <= threshold // 2:
        raise ValueError("start must be at least 8 and at most half the threshold")
    sized = Sized(docs)
    parts = sized.parts(PART_BYTES)
    deals = lambda df, f: deal(df, f, packed.SCHEMA, parts)
    sent = squeezed_texts(sized, parts)
    ranked = staged(deals(sized.df.mapInArrow(_sampled(threshold, parts), packed.SCHEMA), _ranked_runs(parts)), "suffix-runs")
    steps = doublings(threshold, start)
    keys = deals(sent.unionByName(ranked.filter(f"kind = {OPEN}"), allowMissingColumns=True), _prefixes(threshold, start, steps[0], parts))
    ranks = staged(deals(keys, _rank(parts)), "suffix-ranks")
    for step in steps[1:]:
        ranks, before = staged(deals(deals(ranks, _double(step, parts)), _rank(parts)), "suffix-ranks"), ranks
        free(before)
    single = staged(deals(ranks, _repeats(parts)), "suffix-positions")
    free(ranks)
    tune(docs.sparkSession)
    return deal(sent.unionByName(ranked.filter(f"kind = {DONE}"), allowMissingColumns=True).unionByName(single), _cut(threshold, as_text), OUT.format("string" if as_text else "binary"), parts)
