"""Text primitives as built-in column expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from ..refdata import DROPPED, LOOKALIKES, SPACES

#: White space as the regular expressions of the engine see it.
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


#: Rows and characters of texts that a Python worker builds results for at once.
SLICE_ROWS, SLICE_CHARS = 256, 4_000_000


def slices(texts: pd.Series) -> Iterator[slice]:
    """Consecutive rows of a batch, cut so that what is built for them stays small; a longer text is one by itself."""
    upto = np.cumsum(np.asarray([len(t) if t is not None else 0 for t in texts], np.int64))
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(upto, before + SLICE_CHARS, "right"))))
        yield slice(at, end)
        at = end


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """Lines without their ends; no empty last line."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def read_through_lookalikes(text: Column) -> Column:
    """Look-alike letters as the letters they imitate, invisible characters dropped, odd spaces plain."""
    plain = F.translate(text, "".join(LOOKALIKES) + "".join(SPACES), "".join(LOOKALIKES.values()) + " " * len(SPACES))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), DROPPED, plain)


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams, joined by a space; none if there are fewer words."""
    return bound(words, lambda ws: F.array_distinct(F.transform(_starts(ws, n), lambda i: F.array_join(F.slice(ws, i, n), " "))))


def _starts(items: Column, width: int) -> Column:
    """First places of all runs of ``width`` items."""
    return F.when(F.size(items) >= width, F.sequence(F.lit(1), F.size(items) - (width - 1))).otherwise(F.array().cast("array<int>"))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays taken as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set that is in the other; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def occurrences(text: Column, word: str) -> Column:
    """How often ``word`` occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def low_hash(text: Column) -> Column:
    """First eight bytes of SHA-256 read as a little-endian number, as 16 hex digits: their order is the number's."""
    return bound(F.sha2(text, 256), lambda digest: F.concat(*(F.substring(digest, 15 - 2 * k, 2) for k in range(8))))


def winnow(words: Column, k: int = 5, window: int = 4) -> Column:
    """Distinct least hashes of each full window of consecutive k-gram hashes."""
    hashes = bound(words, lambda ws: F.transform(_starts(ws, k), lambda i: low_hash(F.array_join(F.slice(ws, i, k), " "))))
    return bound(hashes, lambda hs: F.array_distinct(F.transform(_starts(hs, window), lambda i: F.array_min(F.slice(hs, i, window)))))


@pandas_udf(ArrayType(StringType()))
def winnowed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """:func:`winnow` of a text's words: each 5-gram is hashed once, least hashes by a sliding minimum over numbers."""
    k, window = 5, 4

    def one(value: str | None) -> list[str] | None:
        if value is None:
            return None
        words = [w for w in _BLANKS.split(value) if w]
        if len(words) < k + window - 1:
            return []
        digests = b"".join(hashlib.sha256(" ".join(words[i : i + k]).encode()).digest()[:8] for i in range(len(words) - k + 1))
        h = np.frombuffer(digests, "<u8")
        least = np.minimum.reduce([h[j : len(h) - window + 1 + j] for j in range(window)])
        _, first = np.unique(least, return_index=True)
        return [f"{v:016x}" for v in least[np.sort(first)].tolist()]

    for text in texts:
        for part in slices(text):
            yield text.iloc[part].map(one)


def stem(identifier: Column) -> Column:
    """camelCase, PascalCase and kebab-case as snake_case; every capital starts a part."""
    parts = F.regexp_replace(F.regexp_replace(identifier, "-", "_"), "(?<=[^_])(?=\\p{Lu})", "_")
    return F.lower(parts)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1; 0 for different lengths, empty or zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (size == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / size)))
