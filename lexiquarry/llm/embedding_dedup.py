"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Iterative quantisation (Gong and Lazebnik 2011) learns, on a bounded sample, rotations after which the signs of the
coordinates are balanced binary codes close to the vectors. Rotations from different starts give a long code. It is cut
into substrings, each the key of one Hamming table; every vector is in every table and probes it with its own substring
and with those one bit away, so any pair is found that differs by one bit at most in some substring. The width of
substrings is the cheapest for the number of vectors, and there are as many rotations and tables as that width needs to
find ``RECALL`` of pairs at the threshold, measured on pairs made from a sample of the vectors. Found pairs whose codes by
the first ``CODES`` rotations differ in more bits than such pairs do are dropped, the rest reranked by the cosine of the
original vectors in double precision. A pair counts in the first table that finds it.

Equal vectors are one class from the start; links are found between classes. Pairs are listed only for buckets of up to
``FEW`` entries. Larger ones are cut into lots, each of a block of those that probe and a block of those that are there;
a lot compares its vectors and sends a number of links for each of them and the links of a spanning forest, so a dense
group is never listed pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, islice
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deal, join_unique, staged, tune
from .components import components

CODES = 2
SAMPLE = 4000
ITERATIONS = 30
#: Links at the threshold differ in so many standard deviations more bits than on average at most.
SLACK = 5.0
#: Share of the pairs at the threshold that the tables have to find.
RECALL = 0.999
WIDEST = 24
#: Entries of a bucket whose pairs are listed at most, and vectors of a block.
FEW, BLOCK = 256, 512


def rotations(x: np.ndarray, bits: int, iterations: int = ITERATIONS) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """The mean of unit vectors, and without end projections of dim x bits."""
    mean = x.mean(0)
    c = x - mean
    _, vectors = np.linalg.eigh(c.T @ c)
    top = vectors[:, ::-1][:, :bits]
    v = c @ top

    def run() -> Iterator[np.ndarray]:
        for k in count(1):
            r = np.linalg.qr(np.random.default_rng(k).standard_normal((top.shape[1], top.shape[1])))[0]
            for _ in range(iterations):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            yield top @ r

    return mean, run()


def boundary(x: np.ndarray, threshold: float, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit vectors whose cosine is the threshold: from each towards any direction, and towards another one."""
    out = []
    for other in (np.random.default_rng(seed).standard_normal(x.shape), np.roll(x, 1, 0)):
        away = other - np.einsum("ij,ij->i", other, x)[:, None] * x
        length = np.linalg.norm(away, axis=1)
        ok = length > 1e-6
        out.append((x[ok], threshold * x[ok] + max(0.0, 1 - threshold**2) ** 0.5 * away[ok] / length[ok, None]))
    return [p for p in out if len(p[0])]


@dataclass
class Tables:
    """How vectors are encoded, the substrings' width and number, and in how many bits of ``coded`` links may differ."""

    mean: np.ndarray
    projection: np.ndarray
    width: int
    tables: int
    coded: int
    most: int


def _needed(apart: list[np.ndarray], width: int, recall: float) -> int | None:
    """The least number of tables that find so many pairs of each kind, from the bits in which these differ."""
    worst = 0
    for d in apart:
        tables = d.shape[1] // width
        hit = d[:, : tables * width].reshape(len(d), tables, width).sum(2, dtype=np.uint8) <= 1
        share = np.logical_or.accumulate(hit, 1).mean(0)
        enough = np.flatnonzero(share >= recall)
        if not len(enough):
            return None
        worst = max(worst, int(enough[0]) + 1)
    return worst


def fit(x: np.ndarray, n: int, threshold: float, recall: float = RECALL) -> Tables:
    """Tables for n vectors of which x is a sample.

    Rotations are added until a width finds enough and twice as many rotations don't allow a much cheaper one. The cost of
    a vector: the table rows that it makes, and the other vectors that it meets if all substrings are as frequent.
    """
    known, fresh = (x[:SAMPLE], x[SAMPLE:]) if len(x) >= 2 * SAMPLE else (x, x)
    mean, more = rotations(known, min(64, x.shape[1]))
    pairs = boundary(fresh, threshold)
    projection, apart, best = [], [np.zeros((len(a), 0), bool) for a, _ in pairs], None
    codes = CODES
    while True:
        new = np.concatenate(list(islice(more, codes - len(projection))), 1)
        bits = new.shape[1] // (codes - len(projection))
        projection += np.split(new, codes - len(projection), 1)
        apart = [np.concatenate([d, encode(a, mean, new) != encode(b, mean, new)], 1) for d, (a, b) in zip(apart, pairs, strict=True)]
        last = best
        for width in range(1, min(bits, WIDEST) + 1):
            tables = _needed(apart, width, recall)
            if tables:
                cost = tables * (1 + width / 2 + (1 + width) * n / 2**width)
                best = min(best or (cost, width, tables), (cost, width, tables))
        if best and last and best[0] > 0.8 * last[0]:
            break
        codes *= 2
    _, width, tables = best
    coded = CODES * bits
    far = [d[:, :coded].sum(1) for d in apart]
    most = min(coded, max(ceil(f.mean() + SLACK * max(f.std(), 1.0)) for f in far))
    used = max(coded, width * tables)
    return Tables(mean, np.concatenate(projection, 1)[:, :used], width, tables, coded, most)


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Bits of unit vectors, as 0 and 1."""
    return ((x - mean) @ projection >= 0).astype(np.uint8)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors' doubles as binary; null for those that link with nothing."""
    for b in batches:
        col = b.column("embedding")
        values = col.flatten()
        ok = np.ones(len(col), bool)
        out = []
        flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
        size = np.array([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()], np.int64)
        end = np.cumsum(size)
        for i, (e, n) in enumerate(zip(end, size, strict=True)):
            v = flat[e - n : e] + 0.0
            ok[i] = n > 0 and np.isfinite(v).all() and (v != 0).any()
            out.append(v.tobytes() if ok[i] else None)
        digest = [None if v is None else hashlib.sha256(v).digest() for v in out]
        yield pa.record_batch({"id": b.column("id"), "key": b.column("key"), "vector": pa.array(out, pa.binary()), "digest": pa.array(digest, pa.binary())})


def _indexed(how: Tables):
    """A vector's rows: its own substrings, in which it's found and with which it probes, and those one bit more."""
    width = how.width
    weight = (1 << np.arange(width)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = encode(_unit(_matrix(b.column("vector"))), how.mean, how.projection)
            n = len(bits)
            whole = np.zeros((n, -(-bits.shape[1] // 64) * 64), np.uint8)
            whole[:, : bits.shape[1]] = bits
            code = pa.array([x.tobytes() for x in np.packbits(whole, axis=1, bitorder="little")], pa.binary())
            key = b.column("key").to_numpy()
            who, at, own = [], [], []
            for t in range(how.tables):
                part = bits[:, t * width : (t + 1) * width]
                value = part.astype(np.int64) @ weight + (t << 40)
                who.append(np.arange(n))
                at.append(value)
                own.append(np.ones(n, bool))
                for k in range(width):
                    zero = np.flatnonzero(part[:, k] == 0)
                    who.append(zero)
                    at.append(value[zero] + weight[k])
                    own.append(np.zeros(len(zero), bool))
            who = np.concatenate(who)
            yield pa.record_batch({"key": pa.array(key[who]), "code": code.take(pa.array(who)), "bucket": pa.array(np.concatenate(at)), "own": pa.array(np.concatenate(own))})

    return run


def _codes(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(len(col), -1)


def _met(how: Tables, x: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs that meet in a table (x: in which bits of the codes they differ): whether they are near enough, and this is
    the first of their tables. Vectors with equal substrings meet twice there, and count where a < b."""
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")
    near = bits[:, : how.coded].sum(1) <= how.most
    apart = bits[:, : how.tables * how.width].reshape(len(x), how.tables, how.width).sum(2, dtype=np.uint8)
    return near & ((apart <= 1).argmax(1) == table) & ((apart[np.arange(len(x)), table] == 1) | (a < b))


def _once(how: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                ok = pa.array(_met(how, _codes(batch.column("ca")) ^ _codes(batch.column("cb")), batch.column("bucket").to_numpy() >> 40, a, b))
                yield pa.record_batch({"a": batch.column("a").filter(ok), "b": batch.column("b").filter(ok)})

    return run


#: What is found: links (a, b), and numbers of vectors linked with a (b null).
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _rerank(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            if r.num_rows:
                ok = np.einsum("ij,ij->i", _unit(_matrix(r.column("va"))), _unit(_matrix(r.column("vb")))) >= threshold
                a, b, na, nb = (r.column(c).to_numpy()[ok] for c in ("a", "b", "na", "nb"))
                none = pa.nulls(len(a), pa.int64())
                yield pa.record_batch({"a": pa.concat_arrays([pa.array(a), pa.array(a), pa.array(b)]), "b": pa.concat_arrays([pa.array(b), none, none]), "n": pa.array(np.concatenate([np.zeros(len(a), np.int64), nb, na]))}, _FOUND)

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and their links the least node of each component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _lots(how: Tables, threshold: float):
    """Compares those that probe (side 0) with those that are in the bucket (side 1), for each lot of a part."""

    def compare(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        key, side = t.column("key").to_numpy(), t.column("side").to_numpy()
        n, code = t.column("n").to_numpy(), _codes(t.column("code").combine_chunks())
        x = _unit(_matrix(t.column("vector").combine_chunks()))
        table = t.column("bucket")[0].as_py() >> 40
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ids, place = np.unique(key, return_inverse=True)
        count, found = np.zeros(len(ids), np.int64), []
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            i, j = np.nonzero((x[some] @ x[right].T >= threshold - 1e-9) & (key[some][:, None] != key[right]))
            i, j = some[i], right[j]
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[ok], j[ok]
            ok = _met(how, code[i] ^ code[j], np.full(len(i), table), key[i], key[j])
            i, j = i[ok], j[ok]
            np.add.at(count, place[i], n[j])
            np.add.at(count, place[j], n[i])
            found.append((place[i], place[j]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        label = _forest(a, b, len(ids))
        tree, linked = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(count)
        yield ids[label[tree]], ids[tree], np.zeros(len(tree), np.int64)
        yield ids[linked], None, count[linked]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("lot", "ascending")])
        cuts = np.flatnonzero(np.diff(table.column("lot").to_numpy())) + 1
        edges = [0, *cuts.tolist(), table.num_rows]
        out = [r for lo, hi in zip(edges, edges[1:]) for r in compare(table.slice(lo, hi - lo))]
        return pa.table({"a": pa.concat_arrays([pa.array(r[0], pa.int64()) for r in out]), "b": pa.concat_arrays([pa.nulls(len(r[0]), pa.int64()) if r[1] is None else pa.array(r[1], pa.int64()) for r in out]), "n": pa.concat_arrays([pa.array(r[2], pa.int64()) for r in out])}, _FOUND)

    return run


def _pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) of the classes (key, n, vector) of one dimension: links, at least a forest of them, and numbers of links."""
    n = classes.count()
    found = "a long, b long, n long"
    if n < 2:
        return classes.sparkSession.createDataFrame([], found)
    sample = classes.orderBy(F.xxhash64("key")).limit(2 * SAMPLE).select("vector").collect()
    how = fit(_unit(np.frombuffer(b"".join(bytes(r["vector"]) for r in sample), np.float64).reshape(len(sample), -1)), n, threshold)
    rows = staged(classes.select("key", "vector").mapInArrow(_indexed(how), "key long, code binary, bucket long, own boolean"), "itq-rows")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("there")).filter("there > 0 and n > 1")
    sizes = staged(sizes, "itq-sizes")
    blocks = sizes.filter(F.col("n") > FEW).select("bucket", "n", F.ceil(F.col("n") / BLOCK).alias("i_blocks"), F.ceil(F.col("there") / BLOCK).alias("j_blocks"))
    sized = join_unique(rows, sizes.select("bucket", (F.col("n") > FEW).alias("large")), "bucket", "inner", sizes)
    few = sized.filter(~F.col("large"))
    left = few.select(F.col("key").alias("a"), F.col("code").alias("ca"), "bucket")
    right = few.filter("own").select(F.col("key").alias("b"), F.col("code").alias("cb"), "bucket")
    once = left.join(right, "bucket").filter("a != b").select("a", "b", "ca", "cb", "bucket").mapInArrow(_once(how), "a long, b long")
    va, vb = (classes.select(F.col("key").alias(c), F.col("vector").alias(f"v{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    listed = once.join(va, "a").join(vb, "b").select("a", "b", "va", "vb", "na", "nb").mapInArrow(_rerank(threshold), found)
    dense = join_unique(rows, blocks.drop("n"), "bucket", "inner", blocks)
    here = F.pmod(F.xxhash64("key"), "i_blocks"), F.pmod(F.xxhash64("key"), "j_blocks")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    probing = dense.select("key", "code", "bucket", F.lit(0).alias("side"), here[0].alias("i"), every("j_blocks").alias("j"))
    there = dense.filter("own").select("key", "code", "bucket", F.lit(1).alias("side"), every("i_blocks").alias("i"), here[1].alias("j"))
    lots = probing.unionByName(there).select("key", "code", "bucket", "side", F.xxhash64("bucket", "i", "j").alias("lot"))
    parts = max(24, n // 2000)
    lots = lots.join(classes.select("key", "n", "vector"), "key").withColumn("part", F.pmod("lot", F.lit(parts)).cast("int"))
    return listed.unionByName(deal(lots, _lots(how, threshold), found, parts))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, vector_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Links vectors whose cosine is ``threshold`` or more.

    Returns for each row the id, n_links (other vectors linked with it), component_id (the least id reachable by links,
    itself included) and kept (id = component_id; of rows that share this id, one). Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing; vectors of different lengths neither. Equal vectors are
    linked. Rows that share an id are vectors of their own; null ids sort before all others. Extra columns are
    ignored; an empty table gives no rows.
    """
    tune(vectors.sparkSession)
    base = vectors.select(F.coalesce(F.col(vector_id).cast("long"), F.lit(-(2**63))).alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    if (base.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > 1 or base.filter(F.col("id") == -(2**63)).limit(1).count():
        base = staged(base.orderBy("id", F.xxhash64("embedding")).withColumn("key", F.monotonically_increasing_id()), "itq-numbered")
    else:
        base = base.withColumn("key", F.col("id"))
    checked = staged(base.select("id", "key", "embedding").mapInArrow(_checked, "id long, key long, vector binary, digest binary"), "itq-vectors")
    ids = checked.select("id", "key", "digest")
    same = checked.filter("vector is not null").groupBy("digest").agg(F.min(F.struct("id", "key")).alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = staged(same.select(F.col("least.key").alias("key"), F.col("least.id").alias("id"), "n", "vector", "digest"), "itq-classes")
    found = None
    for r in classes.select(F.octet_length("vector").alias("d")).distinct().orderBy("d").collect():
        mine = staged(_pairs(classes.filter(F.octet_length("vector") == r["d"]), threshold), "itq-links")
        found = mine if found is None else found.unionByName(mine)
    null = lambda c: F.nullif(c, F.lit(-(2**63)))
    if found is None:
        return checked.select(null(F.col("id")).alias(vector_id), F.lit(0).cast("long").alias("n_links"), null(F.col("id")).alias("component_id"), F.lit(True).alias("kept"))
    labels = components(found.filter("b is not null").select("a", "b"), "itq-labels").withColumnRenamed("node", "lead")
    linked = found.filter("b is null").groupBy(F.col("a").alias("lead")).agg(F.sum("n").alias("others"))
    own = classes.select(F.col("key").alias("lead"), F.col("id").alias("class_id"), "n", "digest").join(linked, "lead", "left").join(labels, "lead", "left")
    own = staged(own.select("lead", "class_id", "digest", "n", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("label", "lead").alias("label")), "itq-own")
    top = own.groupBy("label").agg(F.min(F.struct("class_id", "lead")).alias("top"))
    own = staged(join_unique(own, top, "label").select("digest", "n", "n_links", F.col("top.class_id").alias("component_id"), F.col("top.lead").alias("top_key")), "itq-own")
    got = join_unique(ids, own.drop("n"), "digest", "left", own)
    component = F.coalesce("component_id", "id")
    return got.select(null(F.col("id")).alias(vector_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), null(component).alias("component_id"), F.coalesce(F.col("key") == F.col("top_key"), F.lit(True)).alias("kept"))
