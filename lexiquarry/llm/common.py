"""Shared parts of the text operators: inputs, staged tables, dealing of packed rows, vector hashing.

Most operators here move *packed rows*: one row holds the numpy arrays of many positions, windows or n-grams as
binary columns. A map task pre-aggregates what it has seen (so that a key which fills a third of the table leaves a
task as one entry), splits it by hash over ``parts`` and sends one packed row for each part. ``deal`` brings the rows
of a part together. The number of parts follows the size of the input, so that a part fits a task.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside packed rows; it sorts first.
NULL_ID = -(2**63)
#: Rows and bytes of an Arrow batch: bounds what a Python worker holds of the input at once.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


# --- memory of Python workers ----------------------------------------------------------------------------------


@lru_cache(1)
def _libc():
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    return libc if hasattr(libc, "malloc_trim") else None


def trim() -> None:
    """Gives freed memory back to the system: workers live on after a task, and Spark doesn't count what they hold."""
    if libc := _libc():
        libc.malloc_trim(0)


# --- sessions, inputs, staged tables ---------------------------------------------------------------------------


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
        spark.sparkContext.setCheckpointDir(found)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lexiquarry/{name}-{uuid.uuid4().hex}"

    def forget() -> None:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone
            return

    atexit.register(forget)
    return path


#: Frees a query's shuffle files at its end; if they are asked for again, Spark makes them again.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors.

    The shuffle files of the write are freed at its end, so disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before) if before else spark.conf.unset(CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def free(*done: DataFrame) -> None:
    """Deletes staged tables of which all that is needed has been staged again."""
    for df in done:
        drop_path(df.sparkSession, df.staged_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) of a table, whatever else it has; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def crc_mod(n: int, col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def _repeats(ids: DataFrame) -> tuple[int, int, int, int]:
    """Of (id, b): rows, most rows of an id, sum of b, rows of NULL_ID."""
    each = ids.groupBy("id").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    got = each.agg(F.sum("n"), F.max("n"), F.sum("b"), F.max(F.when(F.col("id") == NULL_ID, F.col("n")))).first()
    return tuple(x or 0 for x in got)


class Sized:
    """(id, sub, text as binary) of a table, with its bytes and rows.

    ``id`` is doc_id (NULL_ID for null, so a doc_id of -2**63 is taken for null). ``sub`` is 0 where doc_ids are unique;
    else it ascends over the rows that share a doc_id, in order of their texts, so that each row is a document of its
    own. For that the table is sorted over all tasks and staged, so no task has to hold the rows of one id. ``unique``
    says that ids are known to be so.
    """

    def __init__(self, docs: DataFrame, unique: bool = False):
        t = texts(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("text").cast("binary").alias("text"))
        tune(docs.sparkSession)
        if unique:
            self.rows, self.bytes = (x or 0 for x in t.agg(F.count("*"), F.sum(F.octet_length("text"))).first())
            most = 1
        else:
            self.rows, most, self.bytes, _ = _repeats(t.select("id", F.octet_length("text").alias("b")))
        if most > 1:
            self.df = staged(t.orderBy("id", "text").select("id", (F.monotonically_increasing_id() + 1).alias("sub"), "text"), "numbered")
        else:
            self.df = t.select("id", F.lit(0).cast("long").alias("sub"), "text")

    def parts(self, part_bytes: int, least: int = 24) -> int:
        return max(least, math.ceil(self.bytes / part_bytes))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): the rows of ``docs`` as a struct, each under a doc_id that is its own.

    Where doc_ids are null or repeated, new ones number the rows in order of doc_id and text.
    """
    t = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, most, _, nulls = _repeats(t.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.lit(0).alias("b")))
    if most <= 1 and not nulls:
        return t
    order = t.orderBy(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")).cast("binary"))
    return staged(order.select("row", F.monotonically_increasing_id().alias("doc_id"), "text"), "keyed")


#: Partitions of a shuffle of packed rows at most; beyond it a task works through several parts, one after the other.
MOST_PARTITIONS = 20_000


def deal(df: DataFrame, func: Callable[[pa.Table], pa.Table], schema: str, parts: int) -> DataFrame:
    """Brings the packed rows of each of ``parts`` parts together. A part's size is bounded by how its number was chosen."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return func(table)
        finally:
            trim()

    return df.repartition(min(parts, MOST_PARTITIONS), "part").groupBy("part").applyInArrow(run, schema)


#: A key with more than one of so many rows is joined apart; so there are at most so many of these keys.
HOT = 1024


def join_unique(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, which has one short row at most for a key, whatever share of ``left`` a key has.

    Keys with more than 1/HOT of the rows of ``left`` are at most HOT, so their rows of ``right`` are broadcast, and those
    of ``left`` stay where they are; the others meet by a shuffle. ``counts`` has the rows of ``left`` for a key as ``n``,
    where they are known (keys with one row may be left out). ``left`` is read several times: give a staged table.
    """
    key = [key] if isinstance(key, str) else key
    counts = left.groupBy(*key).agg(F.count("*").alias("n")) if counts is None else counts.select(*key, "n")
    counts = counts.filter("n > 100")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter((F.col("n") * HOT > total) & F.col(key[0]).isNotNull()).select(*key).collect() if total else []
    if not hot:
        return left.join(right, key, how)
    keys = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*key).schema))
    few = F.broadcast(right.join(keys, key, "left_semi"))
    some = left.join(keys, key, "left_semi").join(few, key, how)
    return left.join(keys, key, "left_anti").join(right, key, how).unionByName(some)


def doc_id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


# --- Arrow batches as numpy ------------------------------------------------------------------------------------


def binary(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a binary column without nulls; the bytes are a view."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of Sized rows in order of (id, sub)."""
    i, s = batch.column("id").to_numpy(), batch.column("sub").to_numpy()
    if len(i) < 2 or bool(np.all((i[1:] > i[:-1]) | ((i[1:] == i[:-1]) & (s[1:] > s[:-1])))):
        return batch
    return batch.take(pa.array(np.lexsort((s, i))))


def gathered(batches: Iterator[pa.RecordBatch], most: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """Joins small batches until their texts reach ``most`` bytes, in order of (id, sub)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("text").nbytes
        if size >= most:
            whole = ordered(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size = [], 0
            yield whole
            del whole
            trim()
    if held:
        yield ordered(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
    trim()


# --- packing ---------------------------------------------------------------------------------------------------


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def expand(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack(ids: np.ndarray, subs: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Positions grouped by document: ``doc`` (ascending) indexes ids and subs; ``pos`` ascends in each document."""
    used, counts = np.unique(doc, return_counts=True)
    step = np.diff(pos.astype(np.int64), prepend=0)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    if len(pos):
        step[first] = pos[first]
    parts = [squeeze(np.diff(ids[used], prepend=0)), squeeze(subs[used]), squeeze(counts.astype(np.uint32)), squeeze(step.astype(np.uint32))]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(parts)


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, subs, doc, pos) of pack()."""
    n = np.frombuffer(b[:16], np.uint32)
    at = 16 + np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    ids, subs, counts, step = (expand(b[at[i] : at[i + 1]], k) for i, k in enumerate((np.int64, np.int64, np.uint32, np.uint32)))
    doc = np.repeat(np.arange(len(counts)), counts)
    run = np.cumsum(step.astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts.astype(np.int64))[:-1]]).astype(np.int64)
    base = run[first] - step[first] if len(step) else run
    return np.cumsum(ids), subs, doc, run - np.repeat(base, counts) if len(step) else run


def merged_docs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """One table of documents, in order of (id, sub), for several; and each one's rows in it."""
    ids, subs = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    o = np.lexsort((subs, ids))
    new = np.ones(len(o), bool)
    new[1:] = (ids[o][1:] != ids[o][:-1]) | (subs[o][1:] != subs[o][:-1])
    at = np.empty(len(o), np.int64)
    at[o] = np.cumsum(new) - 1
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return ids[o][new], subs[o][new], np.split(at, cuts)


def doc_part(ids: np.ndarray, subs: np.ndarray, parts: int) -> np.ndarray:
    """The part of a document."""
    return (mix(ids.astype(np.uint64) + subs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def squeezed_texts(sized: Sized, parts: int) -> DataFrame:
    """Rows (part, kind 0, id, sub, data): each document's text, compressed for its way to the part of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids, subs = b.column("id").to_numpy(), b.column("sub").to_numpy()
            data = [z.compress(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"part": pa.array(doc_part(ids, subs, parts), pa.int32()), "kind": pa.array(np.zeros(len(ids)), pa.int32()), "id": pa.array(ids), "sub": pa.array(subs), "data": pa.array(data, pa.binary())})

    return sized.df.mapInArrow(run, "part int, kind int, id long, sub long, data binary")


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# --- hashing ---------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bases of the rolling hashes: odd, so that they have inverses modulo 2**64.
BASES = (0x9E6C63D0676A9A99, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: One scrambled value for each byte, so that text bytes aren't small numbers.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(p, out=p)
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


class Rolling:
    """Rabin-Karp sums of a sequence of 64-bit values: the hash of any stretch in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        p, self.inv = powers(base, len(values) + 1)
        self.sum = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * p[: len(values)], out=self.sum[1:])

    def of(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sum[end] - self.sum[start]) * self.inv[start]

    def windows(self, n: int) -> np.ndarray:
        """Of every n consecutive values."""
        m = len(self.sum) - n
        with np.errstate(over="ignore"):
            return (self.sum[n:] - self.sum[:m]) * self.inv[:m] if m > 0 else np.zeros(0, np.uint64)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 20


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap``; none crosses an offset."""
    w = ~gap[data]
    before = np.zeros(len(w), bool)
    before[1:] = w[:-1]
    after = np.zeros(len(w), bool)
    after[:-1] = w[1:]
    o = offsets[(offsets > 0) & (offsets < len(w))]
    before[o] = False
    after[o - 1] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


#: The first k bytes of a lane.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lane_keys(nth: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((nth.astype(np.uint64) + np.uint64(1)) * np.uint64(BASES[0]))


_FIRST_LANE = _lane_keys(np.zeros(1))[0]


def _lane_sums(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: int = 0) -> np.ndarray:
    """Of each word the sum of its 8-byte lanes, each scrambled with its place, which is ``first`` and on."""
    buffer = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer, strides=(1,))
    key = _lane_keys(np.array([first]))[0] if first else _FIRST_LANE
    out = mix((lanes[start] & _MASKS[np.minimum(size, 8)]) ^ key)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        at = np.cumsum(more) - more
        nth = np.arange(more.sum()) - np.repeat(at, more) + 1
        left = np.repeat(size[long], more) - 8 * nth
        v = lanes[np.repeat(start[long], more) + 8 * nth] & _MASKS[np.minimum(left, 8)]
        with np.errstate(over="ignore"):
            out[long] += np.add.reduceat(mix(v ^ _lane_keys(nth + first)), at)
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by the words' bytes; worked through in pieces, so memory doesn't follow the data.

    Lanes are scrambled one by one and summed: no polynomial, of which a power of two as the modulus would make long words
    of a certain build collide under any base.
    """
    out = np.empty(len(start), np.uint64)
    size = end - start
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + PIECE, "right")))
        hi = end[j - 1]
        if j == i + 1 and hi - lo > PIECE:  # a single huge word
            acc = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(int(lo), int(hi), PIECE):
                    n = min(int(hi), k + PIECE) - k
                    acc += _lane_sums(data[k : k + n], np.zeros(1, np.int64), np.array([n]), (k - int(lo)) >> 3)[0]
            out[i] = acc
        else:
            out[i:j] = _lane_sums(data[lo:hi], start[i:j] - lo, size[i:j])
        i = j
    with np.errstate(over="ignore"):
        return mix(out + size.astype(np.uint64) * np.uint64(BASES[1]))


def sequence_hashes(hashes: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each stretch between ``bounds`` of a sequence of hashes: each scrambled with its place, summed."""
    n = np.diff(bounds)
    nth = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
    total = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(hashes ^ _lane_keys(nth + seed * PIECE)), out=total[1:])
        return mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(np.uint64) * np.uint64(BASES[1]) + np.uint64(seed))


def first_of(keys: np.ndarray) -> np.ndarray:
    """For each key whether it's the first of its kind."""
    o = np.argsort(keys, kind="stable")
    k = keys[o]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    out = np.empty(len(k), bool)
    out[o] = new
    return out


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indexes in order) for each part."""
    if not len(part):
        return
    o = np.argsort(part.astype(np.uint16) if part.max() < 65536 else part, kind="stable")
    p = part[o]
    cuts = np.flatnonzero(np.diff(p)) + 1
    for idx in np.split(o, cuts):
        yield int(part[idx[0]]), idx


# --- operators that work row by row ----------------------------------------------------------------------------


def beside(docs: DataFrame, func: Callable[[list[str]], dict[str, pa.Array]], fields: str, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as the struct ``row``, and beside it what ``func`` makes of the texts (null: empty).

    Whatever columns ``docs`` has pass through in ``row``, so none can clash with the results.
    """
    tune(docs.sparkSession)
    inner = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"row {inner.schema['row'].dataType.simpleString()}, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = func(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("row"), *got.values()], ["row", *got])
            del got
            trim()

    return inner.mapInArrow(run, schema)
