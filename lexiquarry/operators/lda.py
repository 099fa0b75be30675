"""Online variational LDA over packs of documents: each pass is one job over Arrow batches, with dense kernels for groups of
documents of about the same number of distinct words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a pack, and weights (distinct words by documents, padded) of a group of them.
PACK, GROUP = 1024, 16_384
#: Documents' iterations and the mean change of their topics' weights below which they end, as in the reference.
ITERATIONS, CHANGE = 100, 1e-3


def psi(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers."""
    x = np.asarray(x, np.float64)
    shift = sum(1 / (x + i) for i in range(8))
    y = x + 8
    q = 1 / (y * y)
    return np.log(y) - 0.5 / y - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q / 240))) - shift


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, np.float64)
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    q = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q / 1680))) / y - shift


def exp_psi(x: np.ndarray) -> np.ndarray:
    """exp of digamma in single precision."""
    u = x + np.float32(2)
    t = x * (x + np.float32(4))
    s = 2 * u * (2 * t + 3) / (t * (t + 3)) + 1 / u
    y = x + np.float32(5)
    q = 1 / (y * y)
    return y * np.exp(-(np.float32(0.5) / y + q * (np.float32(1 / 12) - q * np.float32(1 / 120)) + s))


def encoded(tokens: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of each document, its distinct words by number, their counts) of the words of the vocabulary."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    n = len(tokens)
    word = pc.index_in(tokens.flatten(), vocabulary)
    doc = np.repeat(np.arange(n, dtype=np.int64), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
    known = word.is_valid().to_numpy(zero_copy_only=False)
    key, count = np.unique(doc[known] << 32 | word.drop_null().to_numpy().astype(np.int64), return_counts=True)
    return np.bincount(key >> 32, minlength=n).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), count.astype(np.int32)


def groups(sizes: np.ndarray, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, words, counts) of documents with words, in groups of similar size, padded by counts of 0."""
    start = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(-sizes, kind="stable")
    order, at = order[sizes[order] > 0], 0
    while at < len(order):
        n = int(sizes[order[at]])
        docs = order[at : at + max(1, GROUP // n)]
        docs = docs[sizes[docs] >= 0.8 * n - 4]
        inside = np.arange(n) < sizes[docs][:, None]
        place = np.where(inside, start[docs][:, None] + np.arange(n), 0)
        yield docs, words[place], np.where(inside, counts[place], 0).astype(np.float32)
        at += len(docs)


def inferred(beta: np.ndarray, counts: np.ndarray, alpha: float) -> np.ndarray:
    """Weights of the topics of each document; beta (document, word, topic) is exp of the expected log weights."""
    beta = np.ascontiguousarray(beta.transpose(0, 2, 1))
    out = np.empty(beta.shape[:2], np.float32)
    left, gamma = np.arange(len(counts)), np.empty_like(out)
    gamma[:] = alpha + counts.sum(1, keepdims=True) / out.shape[1]
    done = np.zeros(len(counts), bool)
    for _ in range(ITERATIONS):
        theta = exp_psi(gamma)
        ratio = counts / (np.matmul(theta[:, None, :], beta)[:, 0, :] + np.float32(1e-35))
        new = np.float32(alpha) + theta * np.matmul(beta, ratio[:, :, None])[:, :, 0]
        fresh = ~done & (np.abs(new - gamma).mean(1) < CHANGE)
        gamma = new
        if fresh.any():
            out[left[fresh]] = new[fresh]
            done |= fresh
            if done.all():
                return out
            if done.mean() >= 0.5:
                keep = ~done
                left, gamma, beta, counts, done = left[keep], gamma[keep], beta[keep], counts[keep], done[keep]
    out[left[~done]] = gamma[~done]
    return out


@dataclass
class Counted:
    """The vocabulary of a table of tokens and its documents' counts, in packs that are kept until ``free``."""

    vocabulary: list[str]
    packs: DataFrame

    def free(self) -> None:
        self.packs.unpersist()


def counted(tokens: DataFrame, min_df: int, max_df: float, words: int) -> Counted:
    """Of (doc_id, tokens): terms in at least ``min_df`` documents and at most a share ``max_df``, the most frequent ``words``."""
    tokens = tokens.select(F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tokens"))
    try:
        vocabulary = CountVectorizer(inputCol="tokens", outputCol="counts", minDF=min_df, maxDF=max_df, vocabSize=words).fit(tokens).vocabulary
    except IllegalArgumentException as e:
        if "vocabulary size should be > 0" not in str(e) and "maxDF must be >= minDF" not in str(e):
            raise
        vocabulary = []
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = pa.array(shared.value, pa.string())
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                got = encoded(b.slice(at, PACK).column(0), known)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in got], ["sizes", "words", "counts"])

    packs = tokens.mapInArrow(run, "sizes binary, words binary, counts binary")
    return Counted(vocabulary, packs.persist(StorageLevel.DISK_ONLY))


def _unpacked(batches) -> Iterator[list[np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            yield [np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in range(3)]


def _expected(weights: np.ndarray) -> np.ndarray:
    """Expected log weights of the words (word, topic) of topics."""
    return psi(weights) - psi(weights.sum(0))


def _pass(packs: DataFrame, beta: np.ndarray, alpha: float, blocks: int = 16) -> np.ndarray:
    """Sums, over all documents, of the topics' shares of each word's count: (word, topic). Tasks send a block of words each."""
    sc = packs.sparkSession.sparkContext
    shared, shape = sc.broadcast(beta), beta.shape

    def run(batches):
        beta, total = shared.value, np.zeros(shape)
        for pack in _unpacked(batches):
            for _, words, counts in groups(*pack):
                b = beta[words]
                theta = exp_psi(inferred(b, counts, alpha))
                ratio = counts / (np.matmul(b, theta[:, :, None])[:, :, 0] + np.float32(1e-35))
                word, mine = words.ravel(), (ratio[:, :, None] * theta[:, None, :]).reshape(-1, shape[1])
                order = np.argsort(word)
                word = word[order]
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                total[word[first]] += np.add.reduceat(mine[order], first, axis=0)
        for k, part in enumerate(np.array_split(total.astype(np.float32), blocks)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    def added(key, rows):
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in rows.column("part"))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    tasks = packs.coalesce(3 * sc.defaultParallelism)  # each sends a matrix, so their number is bounded
    rows = tasks.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(added, "block int, part binary").collect()
    shared.destroy()
    return np.concatenate([np.frombuffer(r.part, np.float32) for r in sorted(rows)]).reshape(shape).astype(np.float64) * beta


@dataclass
class Topics:
    """A fit: weights of the words (word, topic)."""

    k: int
    passes: int
    vocabulary: list[str]
    weights: np.ndarray = field(repr=False)

    def getK(self) -> int:  # noqa: N802  as Spark's models
        return self.k

    def getMaxIter(self) -> int:  # noqa: N802
        return self.passes

    def getSubsamplingRate(self) -> float:  # noqa: N802
        return 1.0

    def top(self, n: int) -> list[tuple[int, int, str]]:
        """(topic, rank, term)."""
        order = np.argsort(-self.weights / self.weights.sum(0), axis=0, kind="stable")[:n]
        return [(t, r, self.vocabulary[i]) for t in range(self.k) for r, i in enumerate(order[:, t])]

    def _mapped(self, df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
        """kernel(batch, encoded tokens, beta, expected log weights) of batches whose last column is tokens."""
        spread = df.sparkSession.sparkContext.broadcast((self.vocabulary, _expected(self.weights)))

        def run(batches):
            vocabulary, log_beta = spread.value
            known, beta = pa.array(vocabulary, pa.string()), np.exp(log_beta).astype(np.float32)
            for b in batches:
                yield kernel(b, encoded(b.column(b.num_columns - 1), known), beta)

        return df.mapInArrow(run, schema)

    def shares(self, tokens: DataFrame) -> DataFrame:
        """(doc_id, p): shares of the topics; all 0 for a document without a word of the vocabulary."""
        k = self.k

        def kernel(b, pack, beta):
            p = np.zeros((b.num_rows, k))
            for docs, words, counts in groups(*pack):
                gamma = inferred(beta[words], counts, 1 / k).astype(np.float64)
                p[docs] = gamma / gamma.sum(1, keepdims=True)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(p.ravel()))
            return pa.RecordBatch.from_arrays([b.column(0), flat], ["doc_id", "p"])

        mine = tokens.select("doc_id", "tokens")
        return self._mapped(mine, kernel, f"doc_id {mine.schema['doc_id'].dataType.simpleString()}, p array<double>")

    def log_perplexity(self, tokens: DataFrame) -> float:
        """Bound on the negative log likelihood of a token; null without tokens of the vocabulary."""
        k, v, alpha = self.k, len(self.vocabulary), 1 / self.k

        def kernel(b, pack, beta):
            bound = 0.0
            for _, words, counts in groups(*pack):
                mine = beta[words]
                gamma = inferred(mine, counts, alpha).astype(np.float64)
                e = psi(gamma) - psi(gamma.sum(1))[:, None]
                bound += float((counts * np.log(np.matmul(mine, np.exp(e).astype(np.float32)[:, :, None])[:, :, 0].astype(np.float64) + 1e-300)).sum())
                bound += float(((alpha - gamma) * e + lgamma(gamma) - lgamma(alpha)).sum() + (lgamma(alpha * k) - lgamma(gamma.sum(1))).sum())
            return pa.RecordBatch.from_arrays([pa.array([bound]), pa.array([int(pack[2].sum(dtype=np.int64))], pa.int64())], ["bound", "n"])

        bound, n = self._mapped(tokens.select("tokens"), kernel, "bound double, n long").groupBy().sum("bound", "n").first()
        w, eta = self.weights, 1 / k
        topics = ((eta - w) * _expected(w) + lgamma(w) - lgamma(eta)).sum() + (lgamma(eta * v) - lgamma(w.sum(0))).sum() if v else 0.0
        return -(bound + float(topics)) / n if n else None


@dataclass
class Vocabulary:
    vocabulary: list[str]


@dataclass
class Fit:
    """The vocabulary and the topics, in the places of a pipeline's stages."""

    stages: list


def fit(table: Counted, k: int, passes: int, seed: int, offset: float = 1024.0, decay: float = 0.51) -> Fit:
    """``passes`` updates, each over all documents, by rates (offset + t) ** -decay; priors 1/k."""
    v = len(table.vocabulary)
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (v, k))
    for t in range(1, passes + 1 if v else 1):
        rate = (offset + t) ** -decay
        weights = (1 - rate) * weights + rate * (1 / k + _pass(table.packs, np.exp(_expected(weights)).astype(np.float32), 1 / k))
    return Fit([Vocabulary(table.vocabulary), Topics(k, passes, table.vocabulary, weights)])
