"""Benchmark decontamination: a prefix-filtered set join of documents with windows of benchmark items.

A window is ``window`` consecutive words of an item (all of them if it has fewer), seen as a set of shingles of up to
``SHINGLE`` words. A document that contains a window contains all of its shingles, so it's enough to join on the
necessary prefix, which for exact containment is one shingle: the rarest, by counts over all documents. A match places
the window in the document by the shingle's position; places that would begin before or end after the document are
dropped (positional and length bounds); the rest are verified word for word.

The benchmark is worked through in blocks of at most ``BLOCK`` windows, so what a task is sent has a bound; documents
are scanned for each block and are never shuffled. Long items are cut into pieces that together have all of their windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, binary, mix, staged, trim, tune, word_bounds, word_hashes

SHINGLE = 3
#: Words, and so windows, in a block on average (items are dealt by hash): some 20 MB for a task. Windows of a piece.
BLOCK, PIECE = 200_000, 2000

#: A byte's lower case, A-Z only, and the bytes between words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x61:0x7B] = GAP[0x80:] = False


class Words:
    """The words of several texts, with the hash of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.data = LOWER[data]
        self.start, self.end = word_bounds(self.data, offsets, GAP)
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = word_hashes(self.data, self.start, self.end)
        self.bounds = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.rolling = Rolling(self.hash, BASES[1])

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every n consecutive words of one text."""
        at = np.flatnonzero(self.doc[: max(0, len(self.doc) - n + 1)] == self.doc[n - 1 :]) if n else np.zeros(0, np.int64)
        return at, mix(self.rolling.of(at, at + n) + np.uint64(n))

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i : i + n], self.end[i : i + n], strict=True))


class Windows:
    """A block of the benchmark's windows: words, length, items; and the shingles that they hold."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        of: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            raw = text.encode()
            w = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
            words = [w.text(i, 1) for i in range(len(w.start))]
            n = min(window, len(words))
            for i in range(len(words) - n + 1) if n else ():
                of[b" ".join(words[i : i + n])].update([item] if item is not None else [])
        self.words = sorted(of)
        self.items = [sorted(of[w]) for w in self.words]
        self.length = np.array([w.count(b" ") + 1 for w in self.words], np.int64)
        joined = np.frombuffer(b"".join(self.words), np.uint8)
        w = Words(np.concatenate([[0], np.cumsum([len(x) for x in self.words])]).astype(np.int64), joined)
        self.hash = mix(w.rolling.of(w.bounds[:-1], w.bounds[1:])) if self.words else np.zeros(0, np.uint64)
        found = []
        for n in range(1, SHINGLE + 1):
            at, h = w.shingles(n)
            d = w.doc[at]
            ok = (self.length[d] == n) if n < SHINGLE else np.ones(len(d), bool)
            found.append((d[ok], at[ok] - w.bounds[d[ok]], h[ok], np.full(int(ok.sum()), n)))
        self.of, self.offset, self.key, self.size = (np.concatenate(c) for c in zip(*found, strict=True))
        self.shingles = np.unique(self.key)
        self.filter = None
        self.sizes = sorted(set(self.size.tolist()))

    def choose(self, counts: dict[int, int]) -> None:
        """Keeps the rarest shingle of each window (ties: the least hash)."""
        rare = np.array([counts.get(int(k), 0) for k in self.key], np.int64)
        o = np.lexsort((self.key, rare, self.of))
        first = np.ones(len(o), bool)
        first[1:] = self.of[o][1:] != self.of[o][:-1]
        o = o[first]
        o = o[np.argsort(self.key[o], kind="stable")]
        self.of, self.offset, self.key, self.size = self.of[o], self.offset[o], self.key[o], self.size[o]
        self.filter = None
        self.shingles, self.first, self.many = np.unique(self.key, return_index=True, return_counts=True)
        self.sizes = sorted(set(self.size.tolist()))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hashes are shingles here, which shingles they are)."""
        if self.filter is None:
            self.filter = np.zeros(1 << 22, bool)
            self.filter[self.shingles & np.uint64((1 << 22) - 1)] = True
        at = np.flatnonzero(self.filter[hashes & np.uint64((1 << 22) - 1)])
        k = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
        ok = self.shingles[k] == hashes[at]
        return at[ok], k[ok]


def _counts(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        n = np.zeros(len(b.shingles), np.int64)
        for batch in batches:
            w = Words(*binary(batch.column("text")))
            for size in b.sizes:
                n += np.bincount(b.find(w.shingles(size)[1])[1], minlength=len(n))
            del w
            trim()
        at = np.flatnonzero(n)
        yield pa.record_batch({"shingle": pa.array(b.shingles[at].view(np.int64)), "n": pa.array(n[at])})

    return run


_STRETCHES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _hits(block, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            w = Words(*binary(batch.column("text")))
            rows = batch.num_rows
            hit = [[(s["start"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
            items = [set(x) for x in batch.column("items").to_pylist()]
            for size in b.sizes if len(w.start) else ():
                at, h = w.shingles(size)
                place, k = b.find(h)
                many = b.many[k]
                which = np.repeat(b.first[k], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                place = np.repeat(at[place], many)
                ok = b.size[which] == size
                which, place = which[ok], place[ok]
                win = b.of[which]
                start = place - b.offset[which]
                doc, n = w.doc[place], b.length[win]
                ok = (start >= w.bounds[doc]) & (start + n <= w.bounds[doc + 1])
                start, n, win, doc = start[ok], n[ok], win[ok], doc[ok]
                ok = mix(w.rolling.of(start, start + n)) == b.hash[win]
                for s, m, x, d in zip(start[ok].tolist(), n[ok].tolist(), win[ok].tolist(), doc[ok].tolist(), strict=True):
                    if w.text(s, m) == b.words[x]:
                        s -= int(w.bounds[d])
                        hit[d].append((s, s + m))
                        items[d].update(b.items[x])
            n_words = np.diff(w.bounds)
            spans = [_merged(x) for x in hit]
            got = {"row": batch.column("row"), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _STRETCHES), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            if not last:
                got["text"] = batch.column("text")
            yield pa.RecordBatch.from_arrays([*got.values()], [*got])
            del w, got
            trim()

    return run


def _merged(stretches: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for s, e in sorted(stretches):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(e, out[-1]["end"])
        else:
            out.append({"start": s, "end": e})
    return out


def _pieces(window: int):
    """Items as lower-case words; one of more than PIECE windows in pieces, each of its windows in one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for item, raw in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
                n = len(w.start)
                for at in range(0, max(1, n - window + 1), PIECE) if n else ():
                    size = min(n - at, PIECE + window - 1)
                    out.append((item, w.text(at, size), size))
            yield pa.record_batch({"item": pa.array([x[0] for x in out], pa.string()), "text": pa.array([x[1] for x in out], pa.binary()), "n": pa.array([x[2] for x in out], pa.int64())})

    return run


def _block(pieces: DataFrame, n: int, k: int, window: int) -> Windows:
    mine = pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).select("item", "text").collect()
    return Windows([(r["item"], bytes(r["text"]).decode()) for r in mine], window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Finds the benchmark's windows in documents.

    Words are runs outside 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F after lower-casing A-Z. Returns row (the columns of
    ``docs``), n_words, spans (stretches of words inside an occurrence of a window, [start, end)), n_hit (their
    words), items (item_ids as sorted strings) and contaminated.

    Null or empty texts have no words and no windows; a null item_id counts as a hit without an item. Repeated items
    count once; repeated documents are rows of their own. An empty benchmark hits nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tune(spark)
    spans, items = "array<struct<start:long,end:long>>", "array<string>"
    inner = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = f"row {inner.schema['row'].dataType.simpleString()}, n_words long, spans {spans}, items {items}"
    found = inner.select("row", "text", F.array().cast(spans).alias("spans"), F.array().cast(items).alias("items"))
    of = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text")).filter("text is not null")
    pieces = staged(of.mapInArrow(_pieces(window), "item string, text binary, n long").distinct(), "benchmark")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    for k in range(blocks):
        block = _block(pieces, blocks, k, window)
        if len(block.words):
            counts = inner.select("text").mapInArrow(_counts(spark.sparkContext.broadcast(block)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
            block.choose({int(np.int64(r["shingle"]).view(np.uint64)): r["n"] for r in counts})
        last = k == blocks - 1
        found = found.select("row", "text", "spans", "items").mapInArrow(_hits(spark.sparkContext.broadcast(block), last), schema + ("" if last else ", text binary"))
    cover = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", cover).withColumn("contaminated", F.col("n_hit") > 0)
