"""Language ID by string kernels.

The kernel of two texts is the share of n-grams of bytes (n = 1, 2, 3 together: the blended spectrum, by presence)
that they have in common, |a & b| / sqrt(|a| |b|), over all n-grams that the sample texts have. A Nyström map over
``landmarks`` sample texts makes it linear, and one-versus-rest kernel ridge regression fits a score for each language.
A text's scores are its kernels with the landmarks times the coefficients. Landmarks times coefficients is one matrix
(n-grams x languages) made beforehand, so texts are scored by one matrix product a batch: presence x matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, tune

LETTER = regex.compile(r"\p{L}")
ORDERS = (1, 2, 3)
PIECE = 1 << 20
ROWS = 128
#: How steeply regression scores turn into shares.
STEEP = 6.0
UNDETERMINED = "und"


def codes(seg: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of bytes, as numbers that differ between orders."""
    out = np.full(max(0, len(seg) - n + 1), n, np.uint32)
    for k in range(n):
        out = (out << np.uint32(8)) | seg[k : len(seg) - n + 1 + k]
    return out


class Grams:
    """Numbers the n-grams of a sample: by tables for the first two bytes, and by a page for each pair that a third follows."""

    def __init__(self, found: np.ndarray):
        self.codes = np.unique(np.concatenate([[0], found]).astype(np.uint32))
        place = np.arange(len(self.codes), dtype=np.int32)
        order = {n: (self.codes >> 8 * n) == n for n in ORDERS}
        self.one, self.two = np.zeros(1 << 8, np.int32), np.zeros(1 << 16, np.int32)
        self.one[self.codes[order[1]] & 0xFF] = place[order[1]]
        self.two[self.codes[order[2]] & 0xFFFF] = place[order[2]]
        three = self.codes[order[3]] & 0xFFFFFF
        pairs, page = np.unique(three >> 8, return_inverse=True)
        self.page, self.three = np.zeros(1 << 16, np.int32), np.zeros((len(pairs) + 1, 256), np.int32)
        self.page[pairs] = np.arange(1, len(pairs) + 1)
        self.three[page + 1, three & 0xFF] = place[order[3]]

    def places(self, seg: np.ndarray, n: int) -> np.ndarray:
        """The number of each n-gram of the bytes; 0: not in the sample."""
        if n == 1:
            return self.one[seg]
        pair = (seg[:-1].astype(np.int32) << 8) | seg[1:]
        return self.two[pair] if n == 2 else self.three[self.page[pair[:-1]], seg[2:]]


@dataclass
class Model:
    classes: list[str]
    grams: Grams
    landmarks: np.ndarray
    coefficients: np.ndarray
    #: Landmarks times coefficients.
    weights: np.ndarray | None = None

    def presence(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which of the model's n-grams each text has; the first column is for others."""
        out = np.zeros((len(off) - 1, len(self.grams.codes)), np.float32)
        for lo in range(0, len(data), PIECE):
            hi = min(len(data), lo + PIECE)
            seg = data[lo : hi + max(ORDERS) - 1]
            d0, d1 = np.searchsorted(off, [lo, hi - 1], "right") - 1
            edges = np.clip(off[d0 : d1 + 2] - lo, 0, hi - lo)
            doc = np.repeat(np.arange(d0, d1 + 1), np.diff(edges))
            left = off[doc + 1] - lo - np.arange(hi - lo)
            for n in ORDERS:
                if len(seg) >= n:
                    at = self.grams.places(seg, n)[: hi - lo]
                    ok = np.flatnonzero(left[: len(at)] >= n)
                    out[doc[ok], at[ok]] = 1
        out[:, 0] = 0
        return out

    def kernel(self, p: np.ndarray) -> np.ndarray:
        """With each landmark; the landmarks' own sizes are in their columns."""
        return (p @ self.landmarks) / _sizes(p)

    def scores(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Of the regression, for each language."""
        p = self.presence(off, data)
        return (p @ self.weights) / _sizes(p)

    def fold(self) -> None:
        self.weights = self.landmarks @ self.coefficients

    def shares(self, off: np.ndarray, data: np.ndarray) -> np.ndarray:
        s = STEEP * self.scores(off, data)
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _sizes(p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(p.sum(1), 1)).astype(np.float32)[:, None]


def sample(labelled: DataFrame, label: str, per_class: int, classes: int) -> list[tuple[str, str]]:
    """(label, text) of up to ``per_class`` rows of each class, those of least hash.

    The hashes of at most twice as many rows reach the driver, and then the texts of those that are taken. More than
    ``classes`` labels are an error: what is collected has a bound.
    """
    rows = labelled.select(F.col(label).cast("string").alias("label"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text", F.lit(17)))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(classes + 1).collect()}
    if len(counts) > classes:
        raise ValueError(f"more than {classes} labels in {label}")
    if not counts:
        return []
    share = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, (1.5 * per_class + 40) / n))))
    near = rows.filter((F.col("h") / F.lit(2.0**64) + 0.5) <= share[F.col("label")])
    least: dict[str, list] = {}
    for r in near.groupBy("label", "h").count().collect():
        least.setdefault(r["label"], []).append(r["h"])
    taken = [(k, h) for k, hs in least.items() for h in sorted(hs)[:per_class]]
    wanted = F.broadcast(rows.sparkSession.createDataFrame(taken, "label string, h long"))
    picked = near.join(wanted, ["label", "h"]).groupBy("label", "h").agg(F.min("text").alias("text")).collect()
    return [(r["label"], r["text"]) for r in sorted(picked, key=lambda r: (r["label"], r["h"]))]


def train(labelled: DataFrame, label: str = "lang", per_class: int = 300, landmarks: int = 256, ridge: float = 0.1, classes: int = 1000) -> Model | None:
    """Fits a model on a sample of ``per_class`` distinct texts for each of up to ``classes`` labels (null ones are left
    out), with all of its n-grams. None without labels.
    """
    rows = sample(labelled, label, per_class, classes)
    if not rows:
        return None
    names = sorted({k for k, _ in rows})
    texts = [np.frombuffer(t.encode(), np.uint8) for _, t in rows]
    model = Model(names, Grams(np.unique(np.concatenate([np.unique(codes(b, n)) for b in texts for n in ORDERS]))), np.zeros((0, 0)), np.zeros((0, 0)))
    each = max(1, landmarks // len(names))
    first = {k: i for i, (k, _) in reversed(list(enumerate(rows)))}
    mark = [i for i, (k, _) in enumerate(rows) if i - first[k] < each]

    def presence(of: list[int]) -> np.ndarray:
        mine = [texts[i] for i in of]
        return model.presence(np.concatenate([[0], np.cumsum([len(b) for b in mine])]), np.concatenate(mine))

    p = presence(mark)
    model.landmarks = (p / _sizes(p)).T.copy()
    km = np.concatenate([model.kernel(presence(list(range(at, min(len(rows), at + ROWS))))) for at in range(0, len(rows), ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh(km[mark])
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = km @ root
    y = np.array([[1.0 if k == c else -1.0 for c in names] for k, _ in rows])
    w = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    model.coefficients = (root @ w).astype(np.float32)
    model.fold()
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Predicts the language of each whole text.

    Returns row (the columns of ``docs``), lang_pred (a label of the model; ``und`` if the text is null or has no
    letter, or if the model is None) and score (0 to 1; 0 for ``und``). Row by row: ids aren't used, repeated rows get
    equal results, extra columns stay in row; an empty table gives no rows. Equal scores: the first label in order.
    """
    tune(docs.sparkSession)
    if model is not None:
        model = replace(model, landmarks=model.landmarks[:0])
    inner = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = f"row {inner.schema['row'].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                letters = np.array([bool(LETTER.search(t)) for t in b.column("text").to_pylist()], bool)
                label, score = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
                if model is not None:
                    off, data = binary(b.column("text").cast(pa.binary()))
                    s = model.shares(off, data)
                    best = s.argmax(1)
                    label = [model.classes[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, s[np.arange(len(best)), best], 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["row", "lang_pred", "score"])

    return inner.mapInArrow(run, schema)
