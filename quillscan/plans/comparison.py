"""Comparing two file sets: exact copies by digest, near copies by shared fingerprints, stripped licence headers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators.code import fingerprint, matches
from ..operators.structure import structural_matches


def licence_header(text):
    """Lines about a licence or copyright among the first fifteen, joined; null if none."""
    hits = F.filter(F.slice(lines(text), 1, 15), lambda x: F.lower(x).rlike("license|copyright|spdx"))
    return F.when(F.size(hits) > 0, F.array_join(hits, "\n"))


def compare(originals: DataFrame, suspects: DataFrame, least: float = 0.5) -> DataFrame:
    """``original, suspect, kind, similarity, stripped_header`` for files of ``suspects`` that repeat ``originals``.

    Exact copies meet on their digest; files without one meet as in :func:`matches`;
    structural likeness (``structural``) is reported besides, of exact copies too.  The
    two sets are never compared pair by pair.
    """
    left = originals.select(F.col("path").alias("original"), F.sha2("text", 256).alias("digest"), licence_header(F.col("text")).alias("ho"))
    right = suspects.select(F.col("path").alias("suspect"), F.sha2("text", 256).alias("digest"), licence_header(F.col("text")).alias("hs"))
    exact = left.join(right, "digest").select("original", "suspect", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))
    rest = suspects.join(exact.select(F.col("suspect").alias("path")).distinct(), "path", "left_anti")
    near = matches(fingerprint(rest), fingerprint(originals), least, skeletons=False).select(F.col("reference").alias("original"), "suspect", F.lit("near").alias("kind"), "similarity")
    structural = structural_matches(originals, suspects).withColumn("kind", F.lit("structural"))
    found = exact.unionByName(near).unionByName(structural)
    heads = found.join(left.select("original", "ho"), "original").join(right.select("suspect", "hs"), "suspect")
    return heads.select("original", "suspect", "kind", "similarity", (F.col("ho").isNotNull() & F.col("hs").isNull()).alias("stripped_header"))
