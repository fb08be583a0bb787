"""Structural fingerprints of source text: keyword signatures, calls, complexity, and their similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, jaccard, occurrences, overlap, winnow

# Keywords counted for each kind of node, with the letter that stands for it and its rank in a signature.
NODES = [
    ("F", 0, ["function ", "function("]),
    ("A", 3, ["=>"]),
    ("C", 0, ["class "]),
    ("I", 1, ["if(", "if ("]),
    ("E", 3, ["}else", "} else"]),
    ("L", 1, ["for(", "for ("]),
    ("W", 1, ["while(", "while ("]),
    ("D", 3, ["do{", "do {"]),
    ("S", 2, ["switch(", "switch ("]),
    ("c", 3, ["case "]),
    ("T", 2, ["try{", "try {"]),
    ("h", 3, ["catch(", "catch ("]),
    ("f", 3, ["finally{", "finally {"]),
    ("t", 3, ["throw "]),
    ("r", 3, ["return ", "return;"]),
    ("y", 3, ["yield "]),
    ("a", 3, ["await "]),
    ("n", 3, ["new "]),
    ("i", 3, ["import "]),
    ("e", 3, ["export "]),
]
BRANCHES = "ILWDcT"


def signature(text: Column) -> Column:
    """One letter per node found, by rank, then in the order of the node list."""

    def letters(low: Column) -> Column:
        parts = [F.repeat(F.lit(letter), reduce(lambda a, b: a + b, (occurrences(low, k) for k in keys))) for letter, _, keys in sorted(NODES, key=lambda n: n[1])]
        return F.concat(*parts)

    return bound(F.lower(text), letters)


def complexity(sig: Column) -> Column:
    """One more than the number of branching nodes."""
    return F.length(F.regexp_replace(sig, f"[^{BRANCHES}]", "")) + 1


def calls(text: Column) -> Column:
    """Distinct calls of names joined by dots, in order; no name begins with a digit, the first one does with a capital."""
    rest, later = r"[\w$]*+", r"(?!\d)[\w$]++"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"([A-Z]{rest}(?:\.{later})++)\s*+\("), F.lit(1)))


def string_literals(text: Column) -> Column:
    """Distinct quoted literals."""
    return F.size(F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit('"[^"]*"'), F.lit(0)), F.regexp_extract_all(text, F.lit("'[^']*'"), F.lit(0)))))


def sequence_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def structural_similarity(kgrams_a: Column, kgrams_b: Column, sig_a: Column, sig_b: Column, calls_a: Column, calls_b: Column) -> Column:
    """Half from k-grams, the rest from signatures and calls."""
    return 0.5 * jaccard(kgrams_a, kgrams_b) + 0.3 * sequence_similarity(sig_a, sig_b) + 0.2 * overlap(calls_a, calls_b)


def structural_prints(files: DataFrame) -> DataFrame:
    """``path, kgrams, sig, calls`` of texts of more than 200 bytes with at least ten nodes."""
    nodes = files.filter(F.octet_length("text") > 200).select("path", signature(F.col("text")).alias("sig"), calls(F.col("text")).alias("calls")).filter(F.length("sig") >= 10)
    return nodes.withColumn("kgrams", winnow(F.concat(F.split("sig", "(?!^)"), F.col("calls"))))


def structural_matches(originals: DataFrame, suspects: DataFrame, above: float = 0.5) -> DataFrame:
    """``original, suspect, similarity`` of files whose structural similarity exceeds ``above`` (0.5 or more).

    Signatures and calls give 0.5 together, so such a pair shares a k-gram, on which it meets.
    """
    left = structural_prints(originals).select(F.col("path").alias("original"), *(F.col(c).alias(f"o_{c}") for c in ("kgrams", "sig", "calls")))
    right = structural_prints(suspects).withColumnRenamed("path", "suspect")
    meet = left.select("original", F.explode("o_kgrams").alias("h")).join(right.select("suspect", F.explode("kgrams").alias("h")), "h").select("original", "suspect").distinct()
    pairs = meet.join(left, "original").join(right, "suspect")
    score = structural_similarity(F.col("o_kgrams"), F.col("kgrams"), F.col("o_sig"), F.col("sig"), F.col("o_calls"), F.col("calls"))
    return pairs.select("original", "suspect", score.alias("similarity")).filter(F.col("similarity") > above).withColumn("similarity", F.round("similarity", 6))


def likeness(score: Column) -> Column:
    return F.when(score >= 0.9, "Identical").when(score >= 0.7, "Derived").when(score >= 0.5, "Similar").when(score >= 0.3, "Weak").otherwise("None")
