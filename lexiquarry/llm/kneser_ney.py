"""LM scoring: an interpolated modified Kneser-Ney model, counted in Spark and kept as sorted hash arrays.

Counting. A first pass counts words and numbers them, frequent ones first, so that n-grams pack well as tuples of
numbers. A second pass counts n-grams of the highest order: a task sends each distinct n-gram once with its count. An
n-gram goes to the part of its context, which then holds all that follow the context and sums them at once. Where each
word of the context is frequent (more than ``OFTEN`` times in the corpus) there is no bound for that; such n-grams go to
the part of their own hash, and the parts' sums for the context meet in a further step. So no part gathers the n-grams
of a hot context. A part passes one continuation for each n-gram on to the next lower order.

Files. A part writes an array as one file: hashes sorted by bucket, a bucket the prefix of some four of them, of which
the low 32 bits are stored, with counts of a byte each and a list of the larger ones. Two n-grams are taken for one with
a probability of 1e-9 at any size. Files lie in the shared folder, are replaced as a whole when a task runs again, and are
memory-mapped by the workers that score (``MAPPED`` at once at most); where the shared folder isn't a mounted file
system, workers read them into memory instead, up to ``HELD`` bytes.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Sized, binary, by_part, deal, expand, free, gathered, mix, new_path, squeeze, staged, tune, word_bounds, word_hashes
from .decontaminate import LOWER

PART_BYTES = 12 << 20
#: Hash of the end token, and numbers of the begin padding and of unknown words; words are numbered from FIRST.
END = np.uint64(0x5BD1E995A3C59AC3)
BEGIN, UNKNOWN, FIRST = 0, 1, 2
#: A word that occurs more often is frequent; a context with another word is followed by so many n-grams at most.
OFTEN = 1 << 17
MAPPED, HELD = 2000, 512 << 20
ROWS = "part int, kind string, grams binary, counts binary, manifest array<double>"
FIELDS = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("grams", pa.binary()), ("counts", pa.binary()), ("manifest", pa.list_(pa.float64()))])


def range_part(h: np.ndarray, parts: int) -> np.ndarray:
    """The part whose range of hashes holds h; it doesn't descend with h."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """Of rows of word numbers."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(grams.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k] + np.uint64(1))
    return h


def summed(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For distinct hashes in order: where each occurs, and the sum of its counts (a column or several)."""
    if not len(h):
        return np.zeros(0, np.int64), counts
    o = np.argsort(h)
    at = np.flatnonzero(np.concatenate([[True], h[o][1:] != h[o][:-1]]))
    return o[at], np.add.reduceat(counts[o], at, axis=0)


def pack_columns(*columns: np.ndarray) -> bytes:
    """Whole numbers from 0 in columns of equal length, byte by byte: the lowest bytes of a column, then the next."""
    size = [max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 0 for c in columns]
    planes = [np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(-1, 8).T[:n].tobytes() for c, n in zip(columns, size, strict=True)]
    return bytes(size) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_columns(b: bytes, n: int) -> list[np.ndarray]:
    size = b[:n]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[n:]), np.uint8)
    rows = len(raw) // sum(size) if sum(size) else 0
    out, at = [], 0
    for k in size:
        wide = np.zeros((8, rows), np.uint8)
        wide[:k] = raw[at : at + k * rows].reshape(k, rows)
        out.append(np.ascontiguousarray(wide.T).view("<u8").ravel())
        at += k * rows
    return out


def pack_grams(grams: np.ndarray, often: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows of word numbers, which of the words are frequent (bits), and counts; the rows get an order that packs well."""
    first = grams[:, 0]
    if grams.shape[1] > 1 and first.max(initial=0) < 1 << 32:
        o = np.argsort(first << np.uint64(32) | grams[:, 1] & np.uint64(0xFFFFFFFF))
    else:
        o = np.argsort(first)
    grams = grams[o]
    return pack_columns(np.diff(grams[:, 0], prepend=np.uint64(0)), *grams.T[1:], often[o], counts[o])


def unpack_grams(packed: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [unpack_columns(b, order + 2) for b in packed]
    for cols in found:
        cols[0] = np.cumsum(cols[0], dtype=np.uint64)
    cols = [np.concatenate([f[k] for f in found]) for k in range(order + 2)]
    return np.stack(cols[:order], 1), cols[order], cols[order + 1].astype(np.int64)


class Tokens:
    """Words and one end for each text, in order: hash and text of each, and the n-grams that end there."""

    def __init__(self, off: np.ndarray, data: np.ndarray):
        data = LOWER[data]
        start, end = word_bounds(data, off, SPACE)
        word_doc = np.searchsorted(off, start, "right") - 1
        n_docs = len(off) - 1
        self.by_text = np.bincount(word_doc, minlength=n_docs) + 1
        ends = np.cumsum(self.by_text) - 1
        self.doc = np.repeat(np.arange(n_docs), self.by_text)
        self.hash = np.full(len(self.doc), END)
        is_word = np.ones(len(self.doc), bool)
        is_word[ends] = False
        self.hash[is_word] = word_hashes(data, start, end)

    def grams(self, numbers: np.ndarray, order: int, before: int = BEGIN) -> np.ndarray:
        """Rows of the ``order`` values that end at each token; in front of a text there are ``before``s."""
        nth = np.arange(len(numbers)) - np.repeat(np.cumsum(self.by_text) - self.by_text, self.by_text)
        out = np.full((len(numbers), order), before, np.uint64)
        for k in range(order):
            back = order - 1 - k
            ok = np.flatnonzero(nth >= back)
            out[ok, k] = numbers[ok - back]
        return out


# --- arrays ----------------------------------------------------------------------------------------------------

#: From this value on, a count is in the list of large ones.
LARGE = 255


def _places(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash in its part's array, and the bits that are stored."""
    g = mix(h ^ np.uint64(0xA0761D6478BD642F))
    return ((g >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), g & np.uint64(0xFFFFFFFF)


def layout(h: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """The arrays of a file for distinct hashes with values (rows of whole numbers)."""
    buckets = max(1, len(h) // 4)
    bucket, low = _places(h, buckets)
    o = np.argsort(bucket << np.uint64(32) | low)
    values = values.reshape(len(h), -1)[o]
    flat = values.ravel()
    large = np.flatnonzero(flat >= LARGE)
    offsets = np.searchsorted(bucket[o], np.arange(buckets + 1, dtype=np.uint64))
    return [np.array([len(h), buckets, values.shape[1], len(large)], np.uint64), large.astype(np.uint64), flat[large].astype(np.float64), offsets.astype(np.uint32), low[o].astype(np.uint32), np.minimum(flat, LARGE).astype(np.uint8)]


class Array:
    """A file of layout(), looked into where it lies."""

    def __init__(self, raw: np.ndarray):
        self.n, self.buckets, self.width, m = (int(x) for x in raw[:32].view(np.uint64))
        at = 32
        out = []
        for kind, n in ((np.uint64, m), (np.float64, m), (np.uint32, self.buckets + 1), (np.uint32, self.n), (np.uint8, self.n * self.width)):
            size = n * np.dtype(kind).itemsize
            out.append(raw[at : at + size].view(kind))
            at += size
        self.large, self.values, self.offsets, self.low, self.small = out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are here, and their values."""
        bucket, low = _places(h, self.buckets)
        bucket, low = bucket.view(np.int64), low.astype(np.uint32)
        at, end = self.offsets[bucket], self.offsets[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, low = at[left], end[left], low[left]
        found, places = [], []
        while len(left):
            have = self.low[at]
            hit = np.flatnonzero(have == low)
            found.append(left[hit])
            places.append(at[hit])
            at += 1
            go = np.flatnonzero((have < low) & (at < end))
            left, at, end, low = left[go], at[go], end[go], low[go]
        out = np.zeros((len(h), self.width))
        if not found:
            return np.zeros(0, np.int64), out
        ok, place = np.concatenate(found), np.concatenate(places).astype(np.int64)
        flat = place[:, None] * self.width + np.arange(self.width)
        v = self.small[flat].astype(np.float64)
        i, j = np.nonzero(v == LARGE)
        if len(i):
            v[i, j] = self.values[np.searchsorted(self.large, flat[i, j].astype(np.uint64))]
        out[ok] = v
        return ok, out


_maps: OrderedDict[str, Array] = OrderedDict()


@dataclass
class Store:
    """The arrays of a model in a folder: w words (count, rank), n n-grams (count), c and C contexts (sum, n-grams seen once, twice, more)."""

    folder: str
    parts: int
    often: int
    sizes: dict[str, list[int]] = field(default_factory=dict)
    #: Where the numbers of a part's words of a size of count begin, by size and part.
    first: np.ndarray | None = None

    def write(self, name: str, part: int, h: np.ndarray, values: np.ndarray) -> None:
        if not len(h):
            return
        path, new = f"{self.folder}/{name}-{part}", f"{self.folder}/.{name}-{part}-{uuid.uuid4().hex}"
        arrays = layout(h, values)
        if path.startswith("file:"):
            path, new = ("/" + p.removeprefix("file:").lstrip("/") for p in (path, new))
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(new, "wb") as f:
                for a in arrays:
                    a.tofile(f)
            os.replace(new, path)
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(path)
            new = fs.FileSystem.from_uri(new)[1]
            store.create_dir(os.path.dirname(path), recursive=True)
            with store.open_output_stream(new) as f:
                for a in arrays:
                    f.write(a.tobytes())
            store.move(new, path)

    def array(self, name: str, part: int) -> Array:
        path = f"{self.folder}/{name}-{part}"
        found = _maps.pop(path, None)
        if found is None:
            if path.startswith("file:"):
                found = Array(np.memmap("/" + path.removeprefix("file:").lstrip("/"), np.uint8, "r").view(np.ndarray))
            else:
                from pyarrow import fs

                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    found = Array(np.frombuffer(f.read(), np.uint8))
                while _maps and sum(a.small.nbytes + a.low.nbytes for a in _maps.values()) > HELD:
                    _maps.popitem(last=False)
        _maps[path] = found
        if len(_maps) > MAPPED:
            _maps.popitem(last=False)
        return found

    def find(self, name: str, h: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """The values of hashes, 0 for those that aren't in the array; ``part``: where each is, if not by its own range."""
        part = range_part(h, self.parts) if part is None else part
        out = None
        for p, i in by_part(part):
            if self.sizes[name][p]:
                ok, v = self.array(name, p).find(h[i])
                if out is None:
                    out = np.zeros((len(h), v.shape[1]))
                out[i] = v
        return np.zeros((len(h), 4)) if out is None else out

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of words by hash; unknown ones have the count 0."""
        v = self.find("w", h)
        count = v[:, 0]
        rank = sum(v[:, 1 + k] * 256.0**k for k in range(v.shape[1] - 1)).astype(np.int64)
        number = self.first[_magnitude(count), range_part(h, self.parts)] + rank
        return np.where(count > 0, number, UNKNOWN).astype(np.uint64), count


def _magnitude(count: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(count, 1))[1] - 1


def _row(part: int, kind: str, grams: bytes | None, counts: bytes | None, manifest: list | None = None) -> tuple:
    return part, kind, grams, counts, manifest


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(FIELDS)], FIELDS)


# --- counting --------------------------------------------------------------------------------------------------


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            h, n = np.unique(Tokens(*binary(b.column("text"))).hash, return_counts=True)
            part = range_part(h, parts)
            rows = [_row(p, "w", squeeze(h[i]), pack_columns(n[i])) for p, i in by_part(part)]
            yield from _table(rows).to_batches(max_chunksize=256)

    return run


def _sum_words(store: Store):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        h = np.concatenate([expand(x, np.uint64) for x in table.column("grams").to_pylist()])
        n = np.concatenate([unpack_columns(x, 1)[0] for x in table.column("counts").to_pylist()]).astype(np.int64)
        at, n = summed(h, n)
        size = _magnitude(n)
        each = np.bincount(size, minlength=64)
        o = np.argsort(size, kind="stable")
        rank = np.empty(len(n), np.int64)
        rank[o] = np.arange(len(n)) - np.repeat(np.cumsum(each) - each, each)
        store.write("w", part, h[at], np.stack([n, *((rank >> 8 * k) & 255 for k in range(5))], 1))
        return _table([_row(part, "w", None, None, [len(at), float(n.sum()), *each.tolist()])])

    return run


def _hot(often: np.ndarray, order: int) -> np.ndarray:
    """Whether each word of an n-gram's context is frequent."""
    all_of = np.uint64((1 << (order - 1)) - 1)
    return (often & all_of) == all_of


def _gram_parts(grams: np.ndarray, h: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    return np.where(hot, range_part(h, parts), range_part(gram_hash(grams[:, :-1]), parts))


def _send(kind: str, grams: np.ndarray, often: np.ndarray, h: np.ndarray, n: np.ndarray, parts: int) -> list[tuple]:
    part = _gram_parts(grams, h, _hot(often, grams.shape[1]), parts)
    return [_row(p, kind, pack_grams(grams[i], often[i], n[i]), None) for p, i in by_part(part)]


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as numbers, the first flag the lowest bit."""
    return (flags.astype(np.uint64) << np.arange(flags.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def _numbered(t: Tokens, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Number and count of each token's word."""
    each, back = np.unique(t.hash, return_inverse=True)
    number, count = store.words(each)
    return number[back], count[back]


def _count_grams(store: Store, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            t = Tokens(*binary(b.column("text")))
            number, count = _numbered(t, store)
            grams = t.grams(number, order)
            h = gram_hash(grams)
            at, n = summed(h, np.ones(len(h), np.int64))
            often = _bits(t.grams(count > store.often, order, 1)[at])
            yield from _table(_send(f"n{order}", grams[at], often, h[at], n, store.parts)).to_batches(max_chunksize=256)

    return run


def _context_sums(n: np.ndarray) -> np.ndarray:
    return np.stack([n, n == 1, n == 2, n > 2], 1).astype(np.int64)


def _sum_grams(store: Store, order: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        grams, often, n = unpack_grams(table.column("grams").to_pylist(), order)
        h = gram_hash(grams)
        at, n = summed(h, n)
        grams, often, h = grams[at], often[at], h[at]
        store.write(f"n{order}", part, h, n)
        sizes = [len(n), float(n.sum()), *(float((n == k).sum()) for k in (1, 2, 3, 4))]
        rows = []
        if order > 1:
            hot = _hot(often, order)
            context = gram_hash(grams[:, :-1])
            i = np.flatnonzero(~hot)
            first, s = summed(context[i], _context_sums(n[i]))
            store.write(f"c{order}", part, context[i][first], s)
            sizes.append(len(first))
            i = np.flatnonzero(hot)
            first, s = summed(context[i], _context_sums(n[i]))
            context = context[i][first]
            rows += [_row(p, f"C{order}", squeeze(context[j]), pack_columns(*s[j].T)) for p, j in by_part(range_part(context, store.parts))]
            below, often = grams[:, 1:], often >> np.uint64(1)
            h = gram_hash(below)
            at, more = summed(h, np.where(below[:, 0] == BEGIN, n, 1) if order > 2 else np.ones(len(n), np.int64))
            rows += _send(f"n{order - 1}", below[at], often[at], h[at], more, store.parts)
        return _table([_row(part, f"m{order}", None, None, sizes), *rows])

    return run


def _sum_contexts(store: Store):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = []
        for kind in sorted(set(table.column("kind").to_pylist())):
            mine = [r for r in table.to_pylist() if r["kind"] == kind]
            h = np.concatenate([expand(r["grams"], np.uint64) for r in mine])
            s = np.concatenate([np.stack(unpack_columns(r["counts"], 4), 1) for r in mine]).astype(np.int64)
            at, s = summed(h, s)
            store.write(kind, part, h[at], s)
            rows.append(_row(part, kind, None, None, [len(at)]))
        return _table(rows)

    return run


# --- the model -------------------------------------------------------------------------------------------------


@dataclass
class Model:
    store: Store
    order: int
    n_tokens: int
    n_words: int
    discounts: dict[int, np.ndarray]
    lowest: np.ndarray

    def log10(self, off: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray]:
        """For each text: tokens, known tokens, base score and score."""
        t = Tokens(off, data)
        n, store = len(off) - 1, self.store
        each, back = np.unique(t.hash, return_inverse=True)
        number, seen = store.words(each)
        base = np.log10((seen + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))[back]
        d = self.discounts
        c = store.find("n1", gram_hash(number[:, None]))[:, 0]
        p = _interpolated(c, np.broadcast_to(self.lowest, (len(c), 4)), d[1], 1.0 / (self.n_words + 1))[back]
        number, seen = number[back], seen[back]
        grams, often = t.grams(number, self.order), t.grams(seen > store.often, self.order, 1)
        for k in range(2, self.order + 1):
            g = grams[:, self.order - k :]
            hot = _hot(_bits(often[:, self.order - k :]), k)
            context, h = gram_hash(g[:, :-1]), gram_hash(g)
            sums = np.zeros((len(h), 4))
            for name, i in ((f"c{k}", np.flatnonzero(~hot)), (f"C{k}", np.flatnonzero(hot))):
                sums[i] = store.find(name, context[i])
            c = store.find(f"n{k}", h, np.where(hot, range_part(h, store.parts), range_part(context, store.parts)))[:, 0]
            p = _interpolated(c, sums, d[k], p)
        return {"n_tokens": t.by_text, "n_known": np.bincount(t.doc, seen > 0, n), "base_score": np.bincount(t.doc, base, n), "score": np.bincount(t.doc, np.log10(p), n)}


def _interpolated(c: np.ndarray, context: np.ndarray, d: np.ndarray, lower: np.ndarray | float) -> np.ndarray:
    """Discounted counts over the contexts' sums, and the rest by the lower order; that alone where a context is new."""
    total = np.maximum(context[:, 0], 1)
    rest = (context[:, 1:] @ d[1:]) / total
    return np.where(context[:, 0] > 0, np.maximum(c - d[np.minimum(c, 3).astype(int)], 0) / total + rest * lower, lower)


def discounts(n: list[float]) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, from how many n-grams occur 1, 2, 3 and 4 times (Chen and Goodman 1999)."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05 * k), 0.95 * k) for k, x in enumerate(d, 1))])


def _manifest(df: DataFrame, kind: str) -> list[list[float]]:
    """What the parts say of themselves: a short row for each."""
    rows = df.filter(F.col("kind") == kind).select("part", "manifest").collect()
    return [[r["part"], *r["manifest"]] for r in rows]


def _sizes(rows: list[list[float]], parts: int) -> list[int]:
    out = [0] * parts
    for r in rows:
        out[int(r[0])] = int(r[1])
    return out


def train(docs: DataFrame, order: int = 3) -> Model:
    """Counts a model of the given order from the texts of ``docs`` (null: empty, which is one end token).

    Tokens: A-Z lower-cased, runs of bytes outside 0x20 and 0x09-0x0D, then an end. Repeated rows count again; ids
    aren't used. Without any rows every token has the same probability.
    """
    spark = docs.sparkSession
    sized = Sized(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text"), unique=True)
    store = Store(new_path(spark, "kneser-ney"), sized.parts(PART_BYTES), OFTEN)
    counted = deal(sized.df.mapInArrow(_count_words(store.parts), ROWS), _sum_words(store), ROWS, store.parts)
    words = _manifest(counted, "w")
    store.sizes["w"] = _sizes(words, store.parts)
    each = np.zeros((64, store.parts), np.int64)
    for r in words:
        each[:, int(r[0])] = r[3:]
    descending = each[::-1].ravel()
    store.first = (FIRST + np.cumsum(descending) - descending).reshape(each.shape)[::-1]
    rows, contexts, d = sized.df.mapInArrow(_count_grams(store, order), ROWS), None, {}
    held = []
    for k in range(order, 0, -1):
        done = staged(deal(rows, _sum_grams(store, k), ROWS, store.parts), f"grams{k}")
        m = _manifest(done, f"m{k}")
        store.sizes[f"n{k}"] = _sizes(m, store.parts)
        n = np.array([r[1:7] for r in m]).reshape(-1, 6).sum(0)
        d[k] = discounts(n[2:].tolist())
        lowest = np.array([n[1], n[2], n[3], n[0] - n[2] - n[3]])
        free(*held)
        held = [done]
        rows = done.filter(F.col("kind") == f"n{k - 1}")
        if k > 1:
            store.sizes[f"c{k}"] = _sizes([[r[0], r[7]] for r in m], store.parts)
            mine = staged(done.filter(F.col("kind") == f"C{k}"), f"contexts{k}")
            contexts = mine if contexts is None else contexts.unionByName(mine)
    free(*held)
    found = deal(contexts, _sum_contexts(store), ROWS, store.parts).collect() if contexts is not None else []
    for k in range(2, order + 1):
        store.sizes[f"C{k}"] = _sizes([[r["part"], *r["manifest"]] for r in found if r["kind"] == f"C{k}"], store.parts)
    return Model(store, order, int(sum(r[2] for r in words)), sum(store.sizes["w"]), d, lowest)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores each whole text.

    Returns row (the columns of ``docs``), n_tokens, n_known (tokens that the training texts have), base_score (log10
    probability by smoothed word counts), score (by the model) and perplexity (by the model, of a token). A null or
    empty text is one end token. Row by row: ids aren't used, repeated rows get equal scores, extra columns stay in
    row, an empty table gives no rows.
    """
    tune(docs.sparkSession)
    inner = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = f"row {inner.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = model.log10(*binary(b.column("text")))
                cols = [pa.array(got[c].astype(np.int64 if c[:2] == "n_" else np.float64)) for c in ("n_tokens", "n_known", "base_score", "score")]
                yield pa.RecordBatch.from_arrays([b.column("row"), *cols], ["row", "n_tokens", "n_known", "base_score", "score"])

    return inner.mapInArrow(run, schema).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
