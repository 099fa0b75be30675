"""Column functions over text: tokenizers, n-grams, chunks, repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: ColumnLike, min_length: int = 3) -> Column:
    """T1: lower-cased runs of letters, digits and underscores of at least ``min_length``; null gives none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(runs, lambda t: F.char_length(t) >= min_length)


def latin_words(text: ColumnLike, min_length: int = 3) -> Column:
    """T2: lower-cased whole words made of the letters A-Z, a-z and À-ÿ only, of at least ``min_length``."""
    return F.filter(words(text, min_length), lambda t: t.rlike(f"^[A-Za-zÀ-ÿ]{{{min_length},}}$"))


def split_words(text: ColumnLike) -> Column:
    """T3: split at white space; null gives none."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), r"\s+"), lambda t: t != "")


def ngrams(tokens: ColumnLike, low: int, high: int) -> Column:
    """Space-joined n-grams of low to high tokens, shorter ones first."""
    t = _col(tokens)
    each, last = [], t
    for n in range(1, high + 1):
        if n > 1:
            left = F.greatest(F.size(t) - n + 1, F.lit(0))
            last = F.zip_with(F.slice(last, F.lit(1), left), F.slice(t, F.lit(n), left), lambda a, b: F.concat_ws(" ", a, b))
        if n >= low:
            each.append(last)
    return F.concat(*each)


def overlapping_chunks(tokens: ColumnLike, size: int = 510, overlap: int = 128) -> Column:
    """Chunks of ``size`` tokens, each sharing ``overlap`` with the one before; no tokens give one empty chunk."""
    t, step = _col(tokens), size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(t) - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(t, k * step + 1, F.lit(size)))


#: Pairs of wrongly decoded characters, in the order in which they are replaced.
MOJIBAKE = (("Ã¨", "è"), ("Ã ", "à"), ("Ã¹", "ù"), ("Ã²", "ò"), ("Ã¬", "ì"), ("Ã©", "é"))


def fix_mojibake(text: ColumnLike) -> Column:
    out = _col(text)
    for wrong, right in MOJIBAKE:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_accents(text: ColumnLike) -> Column:
    """Latin letters without their accents."""
    return F.translate(_col(text), ACCENTED, PLAIN)


def starts_with_any(tokens: ColumnLike, prefixes: Sequence[str]) -> Column:
    """Whether some token, without accents, starts with one of the prefixes."""
    keys = F.array(*[F.lit(p) for p in prefixes])
    return F.exists(_col(tokens), lambda w: F.exists(keys, lambda k: F.startswith(strip_accents(F.lower(w)), k)))


def trim_unicode(text: ColumnLike) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: ColumnLike) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))
