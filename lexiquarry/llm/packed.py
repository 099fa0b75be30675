"""Packed positions: what the repeat finders send between tasks, and how they find the first of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import by_part, doc_part, expand, merged_docs, pack, squeeze, unpack

#: Rows between tasks. kind 0: a text; the others are set by the operator. key, aux: 64-bit values; nums: small numbers.
SCHEMA = "part int, kind int, id long, sub long, data binary, key binary, aux binary, nums binary"
FIELDS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("sub", pa.int64()), *((c, pa.binary()) for c in ("data", "key", "aux", "nums"))])
TEXT, DONE, OPEN, FORCED, STATE, RANK = range(6)


class Rows:
    """Collects rows of SCHEMA."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, part: int, kind: int, data: bytes, key: bytes | None = None, aux: bytes | None = None, nums: bytes | None = None) -> None:
        self.rows.append((part, kind, None, None, data, key, aux, nums))

    def table(self) -> pa.Table:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(FIELDS)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, FIELDS, strict=True)], FIELDS)

    def batches(self) -> Iterator[pa.RecordBatch]:
        yield from self.table().to_batches(max_chunksize=256)


class Positions:
    """Positions of many packed rows, with one table of documents in order of (id, sub)."""

    def __init__(self, packs: list[bytes]):
        got = [unpack(p) for p in packs]
        self.sizes = [len(g[2]) for g in got]
        if got:
            self.ids, self.subs, at = merged_docs([(g[0], g[1]) for g in got])
            self.doc = np.concatenate([a[g[2]] for a, g in zip(at, got, strict=True)])
            self.pos = np.concatenate([g[3] for g in got])
        else:
            self.ids, self.subs, self.doc, self.pos = (np.zeros(0, np.int64) for _ in range(4))

    @property
    def order(self) -> np.ndarray:
        """Ascends with (id, sub, position); texts hold less than 2**32 positions."""
        return (self.doc.astype(np.uint64) << np.uint64(32)) | self.pos.astype(np.uint64)


def send(rows: Rows, kind: int, ids, subs, doc, pos, parts: int, nums: np.ndarray | None = None, key: np.ndarray | None = None) -> None:
    """Adds rows that bring positions to the parts of their documents."""
    if not len(doc):
        return
    o = np.lexsort((pos, doc))
    doc, pos = doc[o], pos[o]
    for p, i in by_part(doc_part(ids, subs, parts)[doc]):
        rows.add(p, kind, pack(ids, subs, doc[i], pos[i]), key=None if key is None else squeeze(key[o][i]), nums=None if nums is None else squeeze(nums[o][i]))


def raw(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint64)


def groups(keys: tuple[np.ndarray, ...], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes sorted by keys and then order, whether each starts a group)."""
    o = np.lexsort((order, *keys[::-1]))
    new = np.ones(len(o), bool)
    if len(o):
        new[1:] = np.logical_or.reduce([k[o][1:] != k[o][:-1] for k in keys])
    return o, new


def split_kinds(table: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for b in table.to_batches():
        for r in b.to_pylist():
            out.setdefault(r["kind"], []).append(r)
    return out


def nums_of(rows: list[dict], kind=np.uint16) -> np.ndarray:
    return np.concatenate([expand(r["nums"], kind) for r in rows]) if rows else np.zeros(0, kind)


def per_document(rows: list[dict], kind=np.uint16) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """((id, sub), positions, nums) of each document in the rows."""
    if not rows:
        return
    p = Positions([r["data"] for r in rows])
    n = nums_of(rows, kind) if rows[0]["nums"] is not None else np.zeros(len(p.pos), kind)
    o = np.lexsort((p.pos, p.doc))
    cuts = np.flatnonzero(np.diff(p.doc[o])) + 1
    for i in np.split(o, cuts):
        d = p.doc[i[0]]
        yield (int(p.ids[d]), int(p.subs[d])), p.pos[i], n[i]


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the stretches."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(end, n), -1)
    return np.cumsum(edge)[:n] > 0


def spans(mask: np.ndarray) -> list[dict]:
    """Maximal runs of a mask as [start, end)."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
