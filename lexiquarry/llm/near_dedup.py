"""MinHash near-dedup with BagMinHash signatures of word shingles.

A text is a multiset of shingles of ``WIDTH`` words. Each shingle has Poisson processes over its weights, which are
discretised to whole numbers and grouped into a hierarchy of blocks (0,1], (1,2], (2,4], (4,8] ...: the process of a
block has the block's length as its rate; each of its points carries a level in the block and a signature component,
and counts for a text only if the level is within the shingle's weight there. A component of the signature is the
earliest point that counts, so two components agree with the weighted Jaccard similarity as probability (BagMinHash,
Ertl 2018). Points are made in ascending order of time, for all shingles of many texts at once, only until every
component must have been reached.

Texts of equal words are one class from the start. Signatures are banded; every class is first compared with the
least class of its buckets, and the links make components. Where a bucket then still holds several components, members
are compared with those of other components, in blocks, first by signature and then by their words; one link for each
member is kept.
So a group of copies costs a comparison each, and no list of all pairs is ever made. Every link is verified by the exact overlap of the multisets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, SPACE, Rolling, Sized, binary, deal, free, join_unique, mix, sequence_hashes, staged, trim, tune, unsqueezed, word_bounds, word_hashes
from .components import components
from .decontaminate import LOWER

WIDTH = 5
BANDS, ROWS = 28, 6
SIZE = BANDS * ROWS
#: Texts of one leader that are verified together, and members of a bucket that are compared together.
TOGETHER, BLOCK = 128, 512
CHUNK = 1 << 19


def shingles(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, weight) of each distinct shingle; and a hash of each text's words (two columns)."""
    data = LOWER[data]
    start, end = word_bounds(data, off, SPACE)
    doc = np.searchsorted(off, start, "right") - 1
    n = len(off) - 1
    h = word_hashes(data, start, end)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    whole = [sequence_hashes(h, bounds, k + 1) for k in range(2)]
    r = Rolling(h, BASES[0])
    at = np.flatnonzero(doc[: max(0, len(doc) - WIDTH + 1)] == doc[WIDTH - 1 :]) if len(doc) >= WIDTH else np.zeros(0, np.int64)
    s_doc, s = doc[at], mix(r.of(at, at + WIDTH))
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < WIDTH))
    s_doc = np.concatenate([s_doc, short])
    s = np.concatenate([s, mix(r.of(bounds[short], bounds[short + 1]) + np.uint64(1))])
    with np.errstate(over="ignore"):
        o = np.argsort(mix(s + s_doc.astype(np.uint64) * np.uint64(BASES[1])), kind="stable")
    o = o[np.argsort(s_doc[o], kind="stable")]
    s, s_doc = s[o], s_doc[o]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (s_doc[1:] != s_doc[:-1])])) if len(s) else np.zeros(0, np.int64)
    return s_doc[first], s[first], np.diff(np.append(first, len(s))), np.stack(whole, 1)


def bag_min_hash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """Signatures (n, size) of n weighted sets; those of empty sets are 0."""
    out = np.zeros(n * size, np.uint64)
    time = np.full(n * size, np.inf)
    total = np.bincount(doc, weight, n)
    until = (log(size) + 4) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        blocks = []
        low, k = 0, 0
        while len(mine):
            high = 1 << k
            blocks.append((mine, np.full(len(mine), low), np.full(len(mine), high - low), np.full(len(mine), k)))
            low, k = high, k + 1
            mine = mine[weight[mine] > low]
        at, low, length, k = (np.concatenate(c) for c in zip(*blocks, strict=True))
        seed = mix(shingle[at] + mix(k.astype(np.uint64) + np.uint64(11)))
        d, w, t, step = doc[at], weight[at], np.zeros(len(at)), 0
        while len(seed):
            with np.errstate(over="ignore"):
                h = mix(seed + np.uint64(step) * np.uint64(0x9E3779B97F4A7C15))
            step += 1
            t = t - np.log(((h >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / (size * length)
            alive = t < until[d]
            seed, d, w, t, low, length, h = (x[alive] for x in (seed, d, w, t, low, length, h))
            point = mix(h ^ np.uint64(0x6A09E667F3BCC909))
            level = low + 1 + (((point & np.uint64(0xFFFFFFFF)) * length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            ok = level <= w
            slot = d[ok] * size + (((point[ok] >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(time, slot, t[ok])
            best = time[slot] == t[ok]
            out[slot[best]] = mix(point[ok][best])
        todo &= ~np.isfinite(time).reshape(n, size).all(1)
        until[todo] *= 2
    return out.reshape(n, size)


def bands(signatures: np.ndarray) -> np.ndarray:
    v = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = mix(h * np.uint64(BASES[0]) + v[:, :, k])
    return h


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            off, data = binary(b.column("text"))
            doc, s, w, words = shingles(off, data)
            sig = bag_min_hash(doc, s, w, b.num_rows)
            empty = np.bincount(doc, minlength=b.num_rows) == 0
            f1, f2 = (pa.array(words[:, k].astype(np.uint64).view(np.int64), mask=empty) for k in (0, 1))
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * b.num_rows + 1, BANDS, dtype=np.int32)), pa.array(bands(sig).view(np.int64).ravel()))
            short = [x.tobytes() for x in sig.astype(np.uint16)]
            texts = [z.compress(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"key": b.column("key"), "id": b.column("id"), "sub": b.column("sub"), "f1": f1, "f2": f2, "buckets": buckets, "signature": pa.array(short, pa.binary()), "text": pa.array(texts, pa.binary())})
        trim()


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets, each (distinct values in any order, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    union = a[1].sum() + b[1].sum() - common
    return float(common / union) if union else 0.0


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        rows = table.to_pylist()
        bags: dict[int, tuple] = {}
        for r in rows:
            if r["key"] not in bags:
                raw = unsqueezed(r["text"])
                _, s, w, _ = shingles(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
                bags[r["key"]] = (s, w)
        for r in rows:
            if r["key"] != r["lead"]:
                j = weighted_jaccard(bags[r["lead"]], bags[r["key"]])
                if j >= threshold:
                    for c, v in zip(out, (r["lead"], r["key"], j), strict=True):
                        c.append(v)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64())})

    return run


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b, similarity) of the pairs (lead, key) that reach the threshold.

    The texts of up to about TOGETHER pairs of a leader meet in one part; a leader with more is in several.
    """
    n = pairs.groupBy("lead").agg(F.count("*").alias("n"))
    placed = join_unique(pairs, n.select("lead", F.ceil(F.col("n") / TOGETHER).alias("blocks")), "lead", "inner", n)
    placed = placed.select("lead", "key", F.pmod(F.xxhash64("key"), "blocks").alias("block"))
    wanted = placed.unionByName(placed.select("lead", F.col("lead").alias("key"), "block").distinct())
    found = wanted.join(texts.select("key", "text").hint("merge"), "key").withColumn("part", F.pmod(F.xxhash64("lead", "block"), F.lit(parts)).cast("int"))
    return deal(found, _verify(threshold), "a long, b long, similarity double", parts)


class _Lot:
    """Members of a bucket whose texts are compared, each read when it's first needed."""

    def __init__(self, table: pa.Table):
        self.key, self.label, self.side = (table.column(c).to_numpy() for c in ("key", "label", "side"))
        self.band = table.column("band")[0].as_py()
        self.signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(self.key), -1)
        self.buckets = table.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(self.key), -1)
        self.texts = table.column("text")
        self.root = {x: x for x in self.label.tolist()}
        self.elements: np.ndarray | None = None

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def read(self) -> None:
        """Numbers the shingles of all members, a shingle of weight w as w elements."""
        found = []
        for t in self.texts.to_pylist():
            raw = unsqueezed(t)
            _, s, w, _ = shingles(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
            level = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            found.append(mix(np.repeat(s, w) + mix(level.astype(np.uint64))))
        self.size = np.array([len(x) for x in found])
        self.start = np.cumsum(self.size) - self.size
        values, self.elements = np.unique(np.concatenate(found), return_inverse=True)
        self.flag = np.zeros(len(values), np.int32)

    def links(self, least: float, threshold: float) -> Iterator[tuple[int, int, float]]:
        left, right = np.flatnonzero(self.side <= 1), np.flatnonzero(self.side >= 1)
        for a in left:
            b = right[(self.side[right] != self.side[a]) | (self.key[right] > self.key[a])]
            b = b[(self.buckets[b] == self.buckets[a]).argmax(1) == self.band]
            b = b[(self.signature[b] == self.signature[a]).mean(1) >= least]
            mine = self.find(int(self.label[a]))
            b = b[[self.find(int(x)) != mine for x in self.label[b]]] if len(b) else b
            if not len(b):
                continue
            if self.elements is None:
                self.read()
            own = self.elements[self.start[a] : self.start[a] + self.size[a]]
            self.flag[own] = 1
            common = np.add.reduceat(self.flag[self.elements], self.start)
            self.flag[own] = 0
            similarity = common / np.maximum(self.size + self.size[a] - common, 1)
            for k in b[similarity[b] >= threshold]:
                x, y = self.find(int(self.label[a])), self.find(int(self.label[k]))
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    yield int(self.key[a]), int(self.key[k]), float(similarity[k])


def _compare(least: float, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lot", "ascending")])
        cuts = np.flatnonzero(np.diff(table.column("lot").to_numpy())) + 1
        found = [x for i in np.split(np.arange(table.num_rows), cuts) for x in _Lot(table.take(pa.array(i))).links(least, threshold)]
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64()), "similarity": pa.array([x[2] for x in found], pa.float64())})

    return run


def across(members: DataFrame, texts: DataFrame, least: float, threshold: float, parts: int) -> DataFrame:
    """(a, b, similarity): links that connect different labels of the same bucket.

    members: bucket, band, key, label. Only buckets with several labels are looked at. A label with ``BLOCK`` members or
    more makes blocks of its own, the others share blocks; pairs of blocks are lots, but for those of one label alone. So
    a stranger in a large bucket is compared with each member, and these aren't with each other. A pair is compared in its
    first common bucket, if its signatures agree in a share of at least ``least``, and is verified there; a lot sends one
    link at most for each of its members.
    """
    mixed = -(2**63)
    by_label = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    several = by_label.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("bucket")
    owner = F.when(F.col("n") >= BLOCK, F.col("label")).otherwise(F.lit(mixed))
    owners = by_label.join(several, "bucket").select("bucket", owner.alias("owner"), "n").groupBy("bucket", "owner").agg(F.sum("n").alias("n"))
    owners = staged(owners.withColumn("blocks", F.ceil(F.col("n") / BLOCK)), "near-owners")
    x, y = (owners.select("bucket", F.col("owner").alias(f"o{k}"), F.col("blocks").alias(f"b{k}")) for k in (0, 1))
    pairs = x.join(y, "bucket").filter((F.col("o0") < F.col("o1")) | ((F.col("o0") == F.col("o1")) & (F.col("o0") == mixed)))
    first = pairs.select("bucket", F.col("o0").alias("owner"), F.col("b0").alias("own"), F.col("o1").alias("other"), F.col("b1").alias("blocks"), F.lit(0).alias("side"))
    second = pairs.filter("o0 < o1").select("bucket", F.col("o1").alias("owner"), F.col("b1").alias("own"), F.col("o0").alias("other"), F.col("b0").alias("blocks"), F.lit(2).alias("side"))
    plan = first.unionByName(second).groupBy("bucket", "owner").agg(F.first("own").alias("own"), F.collect_list(F.struct("other", "blocks", "side")).alias("others"))
    large = by_label.filter(F.col("n") >= BLOCK).select("bucket", "label", F.col("label").alias("owner"), "n")
    mine = join_unique(members, large.select("bucket", "label", "owner"), ["bucket", "label"], "left", large).withColumn("owner", F.coalesce("owner", F.lit(mixed)))
    mine = join_unique(mine, plan, ["bucket", "owner"], "inner", owners).withColumn("i", F.pmod(F.xxhash64("key"), "own"))
    lots = mine.withColumn("o", F.explode("others")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.blocks") - 1)))
    same = F.col("owner") == F.col("o.other")
    one, two = F.struct("owner", "i"), F.struct(F.col("o.other").alias("owner"), F.col("j").alias("i"))
    side = F.when(~same, F.col("o.side")).when(F.col("i") == F.col("j"), 1).when(F.col("i") < F.col("j"), 0).otherwise(2)
    lots = lots.select("key", "label", "band", F.xxhash64("bucket", F.least(one, two), F.greatest(one, two)).alias("lot"), side.alias("side"))
    found = lots.join(texts.hint("merge"), "key").withColumn("part", F.pmod("lot", F.lit(parts)).cast("int"))
    return deal(found, _compare(least, threshold), "a long, b long, similarity double", parts)


def near_dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Groups texts whose multisets of five-word shingles overlap by ``threshold`` or more (weighted Jaccard).

    Words: A-Z lower-cased, runs of bytes outside 0x20 and 0x09-0x0D; a text of fewer than five words is one shingle.
    Returns for each row doc_id, sub (0; numbers rows that share a doc_id), class_id (the smallest doc_id among the
    texts reachable by links), copy_of (the smallest doc_id with the same words) and kept (first of its class).

    Null texts and those without words are in no group: class_id is their own doc_id. Null doc_ids sort before all
    others. Rows that share a doc_id are documents of their own, in order of their texts. Extra columns are ignored;
    an empty table gives no rows. Of links at exactly the threshold at most 1 in 5000 is missed by all bands.
    """
    spark = docs.sparkSession
    sized = Sized(docs)
    parts = sized.parts(12 << 20)
    key = F.when((F.col("sub") == 0) & (F.col("id") > -(2**62)), F.col("id")).otherwise(F.xxhash64("id", "sub"))
    signed = staged(sized.df.withColumn("key", key).select("key", "id", "sub", "text").mapInArrow(_sign, "key long, id long, sub long, f1 long, f2 long, buckets array<long>, signature binary, text binary"), "near-signed")
    tune(spark)
    members = signed.select("key", "id", "sub", "f1", "f2")
    words = members.filter("f1 is not null").groupBy("f1", "f2").agg(F.min(F.struct("id", "key")).alias("least"), F.count("*").alias("n"))
    words = staged(words.select("f1", "f2", F.col("least.key").alias("lead"), F.col("least.id").alias("lead_id"), "n"), "near-first")
    classes = signed.join(words.select(F.col("lead").alias("key")), "key", "left_semi")
    classes = staged(classes.select("key", "buckets"), "near-classes")

    banded = classes.select("key", F.posexplode("buckets").alias("band", "bucket"))
    full = staged(banded.groupBy("bucket").agg(F.min("key").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "near-full")
    shared = staged(join_unique(banded, full.select("bucket", "lead"), "bucket", "inner", full), "near-buckets")
    free(full)
    pairs = staged(shared.filter("key > lead").groupBy("key").agg(F.min("lead").alias("lead")), "near-pairs")
    links = staged(verified(pairs, signed, threshold, parts), "near-links")
    free(pairs)

    least = threshold - 5 * (threshold * (1 - threshold) / SIZE) ** 0.5
    labels = components(links.select("a", "b"), "near-labels").withColumnRenamed("node", "key")
    of = shared.select("bucket", "band", "key").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    of = staged(of, "near-labelled")
    more = staged(across(of, signed.select("key", "signature", "buckets", "text"), least, threshold, parts), "near-links")
    free(of)
    links = links.unionByName(more)
    labels = components(links.select("a", "b"), "near-final").withColumnRenamed("node", "lead")

    grouped = staged(join_unique(members, words.drop("n"), ["f1", "f2"], "left", words), "near-grouped")
    grouped = staged(join_unique(grouped, labels, "lead", "left").select("key", "id", "sub", "lead_id", F.coalesce("label", "lead", "key").alias("label")), "near-grouped")
    free(signed, classes, shared, words)
    top = grouped.groupBy("label").agg(F.min(F.struct("id", "key")).alias("top"))
    got = join_unique(grouped, top, "label")
    null = lambda c: F.nullif(c, F.lit(-(2**63)))
    return got.select(null(F.col("id")).alias("doc_id"), "sub", null(F.col("top.id")).alias("class_id"), null(F.coalesce("lead_id", "id")).alias("copy_of"), (F.col("key") == F.col("top.key")).alias("kept"))
