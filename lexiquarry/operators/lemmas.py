"""Lemmas and parts of speech by a plugged-in analyser, called by batch; and pooling of what an encoder returns."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Parts of speech that reports keep by default.
CONTENT = ("NOUN", "PROPN", "ADJ")
#: A list of texts to, for each, its (token, lemma, part of speech) triples.
Analyser = Callable[[Sequence[str]], Sequence[Sequence[tuple[str, str, str]]]]


def lemmatized(docs: DataFrame, analyser: Analyser, stops: Collection[str] = (), keep: Collection[str] | None = None, least: int = 2, text: str = "text", out: str = "text_repro") -> DataFrame:
    """Adds ``out``: lower-cased lemmas joined by spaces.

    Tokens of letters only stay whose lemma has ``least`` letters, that aren't stop words as tokens or as lemmas, and
    whose part of speech is in ``keep`` (None: any). A null text has none.
    """
    stops, keep = frozenset(stops), None if keep is None else frozenset(keep)

    def kept(triples: Sequence[tuple[str, str, str]]) -> Iterator[str]:
        for token, lemma, pos in triples:
            lemma, token = lemma.strip().lower(), token.lower()
            if token.isalpha() and len(lemma) >= least and lemma not in stops and token not in stops and (keep is None or pos in keep):
                yield lemma

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [" ".join(kept(t)) for t in analyser([x.lower() for x in b[text].fillna("")])]
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{schema}, {out} string")


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens (text, token, size) that the mask (text, token) counts; for encoders that return all tokens."""
    m = np.asarray(mask, float)[..., None]
    return (states * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def file_label(*names: str) -> str:
    """Names of compared sides as part of a file name."""
    return "_vs_".join(n.replace(" ", "_") for n in names)
