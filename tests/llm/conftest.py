import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture
def rows(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in pairs], "doc_id long, text string, lang string, source string, n_words int, key string")

    return make


@pytest.fixture
def thue_morse():
    """Two words of 512 letters that polynomials modulo a power of two take for one, whatever their base."""
    bits = [bin(k).count("1") & 1 for k in range(512)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
