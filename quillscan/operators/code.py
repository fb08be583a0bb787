"""Code comparison: comment-free normal form, fingerprints, entropy, minified and obfuscated text."""

from __future__ import annotations

import hashlib
import math
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..functions.text import jaccard, low_hash, ngrams, occurrences, tokens, winnowed
from ..storage import written

_PIECES = re.compile(r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#[^\n]*", re.S | re.M)


# Words of a skeleton, words that begin a chunk.
_SKELETON = "if else for while do switch case match try catch finally return break continue throw fn function def class struct enum impl async await yield loop select when".split()
_BEGINS = tuple(f"{w} " for w in "fn function def func sub proc public private protected static class struct enum interface trait impl module namespace".split())


def _normal(text: str) -> str:
    return " ".join(_PIECES.sub(lambda m: m[1] or " ", text).split()).lower()


@pandas_udf(StringType())
def normal_code(code: pd.Series) -> pd.Series:
    """Comments dropped outside strings, white space squeezed, lower case."""
    return code.map(lambda text: None if text is None else _normal(text))


@pandas_udf(StringType())
def skeleton(code: pd.Series) -> pd.Series:
    """Control words with the bracket depth after their line; null if there are none."""

    def one(text: str | None) -> str | None:
        depth, out = 0, []
        for line in (text or "").split("\n"):
            line = line.strip().lower()
            depth += line.count("{") + line.count("(") - line.count("}") - line.count(")")
            out += [f"{depth}:{w}" for w in _SKELETON if line.startswith(w) or f" {w}" in line or f"\t{w}" in line]
        return " ".join(out) or None

    return code.map(one)


@pandas_udf(ArrayType(StringType()))
def chunk_hashes(code: pd.Series) -> pd.Series:
    """Distinct digests of the normal forms of chunks of more than 50 bytes, cut where a function or class begins."""

    def one(text: str | None) -> list[str]:
        lines = (text or "").split("\n")
        first, depth, cuts = 0, 0, [0]
        for i, line in enumerate(map(str.strip, lines)):
            if line.startswith(_BEGINS) and depth <= 1 and i > first + 3:
                cuts.append(first := i)
            for c in line:
                depth = depth + 1 if c == "{" else max(depth - 1, 0) if c == "}" else depth
        chunks = ("\n".join(lines[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(lines)], strict=True))
        return sorted({hashlib.sha256(_normal(c).encode()).hexdigest() for c in chunks if len(c.strip().encode()) > 50})

    return code.map(one)


@pandas_udf(DoubleType())
def byte_entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy of the UTF-8 bytes, in bits."""

    def one(value: str | None) -> float:
        data = (value or "").encode()
        return -sum(n / len(data) * math.log2(n / len(data)) for n in (data.count(b) for b in set(data))) if data else 0.0

    return text.map(one)


def fingerprint(files: DataFrame) -> DataFrame:
    """``ord, path, normal_hash, skeleton_hash, winnow, chunks, grams, loc`` of each text."""
    normal = files.withColumn("_n", normal_code("text")).withColumn("_s", skeleton("text")).withColumn("_c", chunk_hashes("text"))
    words = tokens(F.col("_n"))
    return normal.select(
        "ord", "path", F.sha2("_n", 256).alias("normal_hash"), F.sha2("_s", 256).alias("skeleton_hash"), F.coalesce(winnowed("_n"), F.array().cast("array<string>")).alias("winnow"), F.col("_c").alias("chunks"), ngrams(words, 3).alias("grams"), (occurrences(F.col("text"), "\n") + 1).alias("loc")
    )


# Similarity of equal skeletons, least Jaccard of chunks and of trigrams.
SKELETON_SIMILARITY, CHUNK_LEAST, GRAM_LEAST = 0.95, 0.8, 0.8


def _meet(left: DataFrame, right: DataFrame, items: str, least: float) -> DataFrame:
    """Pairs that may have a Jaccard of ``least``: they share one of the first items of both in one order, enough of them that none is lost."""
    size = F.size(items)
    few = F.slice(F.array_sort(items), F.lit(1), F.greatest(F.lit(0), (size - F.ceil(size * least - 1e-9) + 1).cast("int")))
    ends = [df.select(name, F.explode(few).alias("_h")) for df, name in ((left, "suspect"), (right, "reference"))]
    return ends[0].join(ends[1], "_h").select("suspect", "reference")


def matches(suspects: DataFrame, references: DataFrame, least: float = 0.6, shared: int = 1, skeletons: bool = True) -> DataFrame:
    """Suspect and reference fingerprints that are alike, by the first that holds of: equal normal form (1.0), equal
    skeleton (0.95, unless ``skeletons`` is off), winnowed Jaccard of at least ``least``, chunk Jaccard and trigram
    Jaccard of at least 0.8.

    Candidates meet by equality of a hash or on shared items, never by comparing everything with
    everything, and every pair that can reach a threshold meets.  Texts without control words
    have no skeleton, those of fewer than three words no trigrams: nothing there is alike.
    """
    names = ["normal_hash", "skeleton_hash", "winnow", "chunks", "grams"]
    left = written(suspects.select(F.col("path").alias("suspect"), *names), "suspects")  # each is used several times
    right = written(references.select(F.col("path").alias("reference"), *names), "references")
    same = [left.select("suspect", h).join(right.select("reference", h), h).select("suspect", "reference") for h in (["normal_hash", "skeleton_hash"] if skeletons else ["normal_hash"])]
    near = [_meet(left, right, items, at) for items, at in (("winnow", least), ("chunks", CHUNK_LEAST), ("grams", GRAM_LEAST))]
    meet = reduce(DataFrame.union, same + near).distinct()
    pairs = meet.join(left, "suspect").join(right.select("reference", *(F.col(n).alias(f"r_{n}") for n in names)), "reference")
    alike = {items: jaccard(F.col(items), F.col(f"r_{items}"), 0.0) for items in ("winnow", "chunks", "grams")}
    similarity = F.when(F.col("normal_hash") == F.col("r_normal_hash"), F.lit(1.0))
    if skeletons:
        similarity = similarity.when(F.col("skeleton_hash") == F.col("r_skeleton_hash"), F.lit(SKELETON_SIMILARITY))
    similarity = similarity.when((alike["winnow"] >= least) & (F.size(F.array_intersect("winnow", "r_winnow")) >= shared), alike["winnow"])
    similarity = similarity.when(alike["chunks"] >= CHUNK_LEAST, alike["chunks"]).when(alike["grams"] >= GRAM_LEAST, alike["grams"])
    return pairs.select("suspect", "reference", F.round(similarity, 6).alias("similarity")).filter(F.col("similarity") >= least)


# Generic font families.
GENERIC_FONTS = ["serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "ui-serif", "ui-sans-serif", "ui-monospace", "ui-rounded", "inherit", "initial", "unset", "emoji"]


def endpoints(text: Column) -> Column:
    """Quoted http(s) URLs of 5 to 200 characters, distinct, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[\"'`](https?://[^\"'`\\s]+)[\"'`]"), F.lit(1)), lambda u: F.length(u).between(5, 200)))


def links(html: Column) -> Column:
    """Targets of src and href attributes."""
    return F.regexp_extract_all(html, F.lit("(?:src|href)=[\"']([^\"']+)[\"']"), F.lit(1))


def obfuscation(text: Column) -> Column:
    """0 to 1: hex names, escapes, packed code, long lines and base64 blocks add up."""
    signals = [(text.rlike("_0x[0-9a-f]{4,}"), 0.3), (text.contains("eval("), 0.15), (F.regexp_count(text, F.lit(r"\\x[0-9a-fA-F]{2}")) > 20, 0.2), (F.array_max(F.transform(F.split(text, "\n"), F.length)) > 50_000, 0.15), (text.rlike("[A-Za-z0-9+/]{100,}={0,2}"), 0.1), (text.contains("String.fromCharCode"), 0.1)]
    total = sum((F.when(t, F.lit(w)).otherwise(F.lit(0.0)) for t, w in signals), F.lit(0.0))
    return F.least(F.lit(1.0), total)


def u64_hash(text: Column) -> Column:
    return low_hash(text)
