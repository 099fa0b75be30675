"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks, each with a vector of hashed tag-path names, hashed words and a few
numbers. A bidirectional LSTM reads the sequence both ways, so that every block is classified by the whole page, and
the blocks that it takes for main text are joined. Pages of similar length are labelled together; a page of many blocks
by itself, with the vectors of a stretch of it at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_tagger import Tagger, padded, trained
from .common import tune
from .html_blocks import blocks, features

#: Blocks, with their padding, that are labelled together.
TOGETHER = 8192


def main_texts(tagger: Tagger, pages: list[str]) -> list[list[str]]:
    """The main blocks of each page."""
    found = [blocks(p) for p in pages]
    out: list[list[str]] = [[] for _ in pages]
    order = sorted((k for k in range(len(pages)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        if len(mine := found[order[at]]) > TOGETHER:
            scores = tagger.long_scores(lambda lo, hi, mine=mine: features(mine, lo, hi), len(mine))
            out[order[at]] = [b.text for b, s in zip(mine, scores, strict=True) if s >= 0.5]
            at += 1
            continue
        end = at + 1
        while end < len(order) and (end - at + 1) * len(found[order[end]]) <= TOGETHER:
            end += 1
        mine = order[at:end]
        x, mask, _ = padded([(features(found[k]), np.zeros(len(found[k]), np.float32)) for k in mine])
        scores = tagger.scores(x, mask)
        for i, k in enumerate(mine):
            out[k] = [b.text for b, s in zip(found[k], scores[:, i], strict=False) if s >= 0.5]
        at = end
    return out


def extract(pages: DataFrame, html: str = "html", tagger: Tagger | None = None) -> DataFrame:
    """Extracts the main text of each whole page.

    Returns row (the columns of ``pages``), blocks (main blocks in page order, white space as one space, character
    references decoded) and text (the blocks joined by two line feeds). Null or empty html, or pages without main
    text: no blocks, an empty text. Row by row: ids and urls aren't used, so repeated or null ones need no rule; extra
    columns stay in row; an empty table gives no rows.
    """
    tune(pages.sparkSession)
    tagger = tagger or trained()
    inner = pages.select(F.struct("*").alias("row"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    schema = f"row {inner.schema['row'].dataType.simpleString()}, blocks array<string>, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = main_texts(tagger, b.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(got, pa.list_(pa.string())), pa.array(["\n\n".join(x) for x in got], pa.string())], ["row", "blocks", "text"])

    return inner.mapInArrow(run, schema)
