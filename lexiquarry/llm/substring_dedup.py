"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark.

A map task hashes each window of ``window`` words of its documents, keeps the first of equal windows and deals the
hashes over parts; a part counts the windows that tasks have in common and keeps the earliest. All others are
repeats; they go to the part of their document, where they merge into maximal removal intervals. Every text moves
once, compressed. A window that many documents share leaves each map task once, so no part gathers a hot window.

A hash has 64 bits and the part comes from a second hash, so windows are told apart by 64 bits and log2(parts) more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed
from .common import BASES, SPACE, Rolling, Sized, by_part, binary, deal, doc_id_array, first_of, gathered, mix, pack, squeezed_texts, tune, unsqueezed, word_bounds, word_hashes
from .packed import DONE, OPEN, TEXT

PART_BYTES = 12 << 20
OUT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hashed(window: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            rows = packed.Rows()
            ids, subs = b.column("id").to_numpy(), b.column("sub").to_numpy()
            off, data = binary(b.column("text"))
            start, end = word_bounds(data, off, SPACE)
            if len(start) < window:
                continue
            doc = np.searchsorted(off, start, "right") - 1
            g = word_hashes(data, start, end)
            del end, data
            at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
            first_word = np.searchsorted(doc, np.arange(len(ids)))
            key = mix(Rolling(g, BASES[0]).windows(window)[at])
            part = (mix(Rolling(mix(g), BASES[1]).windows(window)[at]) % np.uint64(parts)).astype(np.uint32)
            doc = doc[at]
            pos = at - first_word[doc]
            first = first_of(key)
            for p, i in by_part(np.where(first, part, parts)):
                if p == parts:
                    packed.send(rows, DONE, ids, subs, doc[i], pos[i], parts)
                else:
                    rows.add(p, OPEN, pack(ids, subs, doc[i], pos[i]), key=key[i].tobytes())
            yield from rows.batches()

    return run


def _counted(parts: int):
    def run(table: pa.Table) -> pa.Table:
        rows = packed.Rows()
        kinds = packed.split_kinds(table)
        for r in kinds.get(DONE, []):
            rows.add(r["part"], DONE, r["data"])
        if found := kinds.get(OPEN):
            p = packed.Positions([r["data"] for r in found])
            key = packed.raw([r["key"] for r in found])
            o, new = packed.groups((key,), p.order)
            later = o[~new]
            packed.send(rows, DONE, p.ids, p.subs, p.doc[later], p.pos[later], parts)
        return rows.table()

    return run


def _cut(window: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = packed.split_kinds(table)
        repeats = {k: pos for k, pos, _ in packed.per_document(kinds.get(DONE, []))}
        out: list[list] = [[] for _ in range(5)]
        for r in kinds.get(TEXT, []):
            words = unsqueezed(r["data"]).split()
            at = repeats.get((r["id"], r["sub"]))
            gone = packed.covered(len(words), at, at + window) if at is not None else np.zeros(len(words), bool)
            for c, v in zip(out, (r["id"], len(words), int(gone.sum()), packed.spans(gone), b" ".join(compress(words, ~gone)).decode()), strict=True):
                c.append(v)
        return pa.table({"doc_id": doc_id_array(np.array(out[0], np.int64)), "n_words": pa.array(out[1], pa.int64()), "n_removed": pa.array(out[2], pa.int64()), "spans": pa.array(out[3], _SPANS), "text": pa.array(out[4], pa.string())})

    return run


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Removes each word covered by a window of ``window`` words that also starts earlier.

    Earlier: in a smaller doc_id, or before it in the same document. Words are runs of bytes outside 0x20 and
    0x09-0x0D, unchanged. Windows are judged on the input. Returns doc_id, n_words, n_removed, spans (the maximal
    removed runs of words, [start, end)) and text (the kept words joined by one space).

    Null or empty text: no words, an empty text. Null doc_id: sorts before all others. Rows that share a doc_id are
    documents of their own, in order of their texts. An empty table gives no rows; extra columns are ignored.
    """
    sized = Sized(docs)
    parts = sized.parts(PART_BYTES)
    hashed = sized.df.mapInArrow(_hashed(window, parts), packed.SCHEMA)
    repeats = deal(hashed, _counted(parts), packed.SCHEMA, parts)
    both = squeezed_texts(sized, parts).unionByName(repeats, allowMissingColumns=True)
    tune(docs.sparkSession)
    return deal(both, _cut(window), OUT, parts)
