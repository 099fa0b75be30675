"""Nearest vectors of some by cosine, exactly: products of blocks, whose best pairs are computed again as the column function does."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm
from ..sources.readers import spread

#: Queries that meet a batch of vectors at once, and how far a product may be from the rounded cosine.
BLOCK, SLACK = 256, 2e-6


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added in the order of the components."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        out = out + x * y
    return out


def _millionths(x: np.ndarray) -> np.ndarray:
    """Rounded to 6 places, half up, as a decimal."""
    y = np.abs(x) * 1e6
    r = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6):
        r[i] = int(Decimal(repr(float(abs(x[i])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.sign(x) * r + 0.0


def _best(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k first of each q by r, descending, then id."""
    order = np.lexsort([ids, -r, q])
    q = q[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[nth < k]


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, key, cosine): at least the k nearest other vectors of each for which ``queries`` holds, by cosine rounded to
    6 places, then key.

    Each task compares its vectors with all queries, which are sent to it, and returns the k best of each query. Vectors without a
    cosine (null, zero, of another length, not finite) meet the queries, and those among the queries all vectors, by the column function.
    """
    v = vectors.filter(F.col(key).isNotNull()).select(key, embedding)
    length = v.agg(F.mode(F.size(embedding))).first()[0] or 0
    n = norm(F.col(embedding))
    plain = F.coalesce((F.size(embedding) == length) & n.between(1e-150, 1e150) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    v = v.withColumn("plain", plain)
    asked = v.filter(queries)
    mine = asked.filter("plain").select(key, embedding).toArrow().combine_chunks()
    sent = v.sparkSession.sparkContext.broadcast((mine.column(0).to_numpy(), _matrix(mine.column(1).combine_chunks()) if len(mine) else np.zeros((0, length))))

    def run(batches):
        asked, q = sent.value
        qn = np.sqrt(_dots(q, q))
        best = [[np.zeros(0, np.int64), np.zeros(0), asked[:0]] for _ in range(0, len(asked), BLOCK)]
        for b in batches:
            if not b.num_rows or not len(asked):
                continue
            ids, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
            xn = np.sqrt(_dots(x, x))
            unit = (x / xn[:, None]).T
            for i, held in enumerate(best):
                part = slice(i * BLOCK, (i + 1) * BLOCK)
                s = (q[part] / qn[part, None]) @ unit
                s[asked[part, None] == ids] = -np.inf
                least = np.partition(s, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)] - SLACK
                worst, number = np.full(len(s), np.inf), np.bincount(held[0], minlength=len(s))
                np.minimum.at(worst, held[0], held[1])
                least = np.where(number == k, np.maximum(least, worst / 1e6 - SLACK), least)
                a, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                r = _millionths(_dots(q[part][a], x[c]) / (qn[part][a] * xn[c]))
                all_of = [np.concatenate(z) for z in zip(held, (a, r, ids[c]))]
                keep = _best(*all_of, k)
                best[i] = [z[keep] for z in all_of]
        for i, (a, r, ids) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(asked[i * BLOCK :][a]), pa.array(ids), pa.array(r / 1e6)], ["query_id", key, "cosine"])

    kind = v.schema[key].dataType.simpleString()
    found = spread(v.filter("plain").select(key, embedding)).mapInArrow(run, f"query_id {kind}, {key} {kind}, cosine double")
    q = asked.select(F.col(key).alias("query_id"), F.col(embedding).alias("q"), F.col("plain").alias("plain_q"))
    other = v.join(q, (F.col(key) != F.col("query_id")) & ~(F.col("plain") & F.col("plain_q")))
    return found.unionByName(other.select("query_id", key, F.round(cosine(F.col("q"), F.col(embedding)), 6).alias("cosine")))
