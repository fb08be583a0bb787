"""Forensics of licence texts: odd characters, missing clauses, additions, version confusion, mixed texts, trust."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.license import families_in_text, licence_of_text
from ..functions.text import bound
from ..refdata import DROPPED, LOOKALIKES, SPACES
from ..refdata_licences import BIDI, CLAUSE_PENALTIES, CLAUSES, EXTRA_SECTIONS, INVISIBLE, RESTRICTIONS, TRANSLATED, VERSION_FAMILIES, VERSION_MARKERS

#: Characters of each kind of anomaly.
KINDS = {
    "Homoglyph": "".join(LOOKALIKES),
    "ZeroWidth": "".join(DROPPED),
    "NonStandardWhitespace": "".join(SPACES),
    "BidiOverride": "".join(map(chr, BIDI)),
    "InvisibleFormatting": "".join(map(chr, INVISIBLE)),
}
ODD = "".join(KINDS.values())


def odd_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ODD, ""))


def unicode_anomalies(files: DataFrame, key: str = "ord") -> DataFrame:
    """``key, position, kind, character``: every odd character with its byte offset and code point.

    Texts without one are filtered out before any text is taken apart.
    """
    chars = files.filter(odd_count(F.col("text")) > 0).select(key, "text", F.posexplode(F.split("text", "")).alias("at", "c")).filter(F.col("c").isin(list(ODD)))
    kind = reduce(lambda w, k: w.when(F.col("c").isin(list(KINDS[k])), k), list(KINDS)[1:], F.when(F.col("c").isin(list(KINDS["Homoglyph"])), "Homoglyph"))
    return chars.select(key, F.octet_length(F.left("text", F.col("at"))).alias("position"), kind.alias("kind"), F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii("c")), 4, "0")).alias("character"))


def clause_key(declared: Column) -> Column:
    """Which clause list a declared licence has; null for none."""
    up = F.upper(declared)
    return (
        F.when(up.contains("MIT"), "MIT").when(up.contains("APACHE"), "APACHE").when(up.contains("AGPL"), "AGPL").when(up.contains("GPL") & ~up.contains("LGPL"), "GPL")
        .when(up.contains("BSD-3") | up.contains("BSD3"), "BSD-3").when(up.contains("MPL"), "MPL")
    )


def missing_clauses(text: Column, declared: Column) -> Column:
    """Array of (clause, obligation, penalty) that the declared licence's text lacks; empty for other licences."""
    low, key = F.lower(text), clause_key(declared)

    def lacking(own: list[tuple]) -> Column:
        return F.array_compact(F.array(*(F.when(~low.contains(s.lower()), F.struct(F.lit(n).alias("clause"), F.lit(o).alias("obligation"), F.lit(CLAUSE_PENALTIES.get(o, 0.05)).alias("penalty"))) for _, n, o, s in own)))

    lists = {k: [c for c in CLAUSES if c[0] == k or (k == "AGPL" and c[0] == "GPL")] for k in ("MIT", "APACHE", "AGPL", "GPL", "BSD-3", "MPL")}
    none = F.array().cast("array<struct<clause:string,obligation:string,penalty:double>>")
    return F.coalesce(reduce(lambda w, k: w.when(key == k, lacking(lists[k])), list(lists)[1:], F.when(key == "MIT", lacking(lists["MIT"]))), none)


def extra_sections(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.contains(s), F.lit(s)) for s in EXTRA_SECTIONS)))


def custom_restrictions(text: Column) -> Column:
    """Array of (pattern, kind, line) of each restrictive phrase, with the number of its first line."""
    low = F.lower(text)

    def line(low: Column, phrase: str) -> Column:
        before = F.left(low, F.instr(low, phrase) - 1)
        return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1

    return bound(low, lambda low: F.array_compact(F.array(*(F.when(low.contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(k).alias("kind"), line(low, p).alias("line"))) for p, k in RESTRICTIONS))))


def version_confusion(text: Column, declared: Column) -> Column:
    """The first licence version, in the table's order, that the text describes and that contradicts the declared one; null if none."""
    low, up = F.lower(text), F.upper(declared)

    def contradicts(version: str, markers: list[str]) -> Column:
        told = reduce(lambda a, b: a | b, (low.contains(m) for m in markers))
        own = version.upper()
        related = [up.contains(f) for f in VERSION_FAMILIES if f in own]
        return told & reduce(lambda a, b: a | b, related) & ~up.contains(own) & ~F.lit(own).contains(up)

    return F.coalesce(*(F.when(contradicts(v, m), F.lit(v)) for v, m in VERSION_MARKERS))


def is_chimera(families: Column) -> Column:
    return F.size(families) >= 3


def mixed_pair(families: Column) -> Column:
    """Two families that do not go together."""
    has = lambda *names: reduce(lambda a, b: a | b, (F.array_contains(families, n) for n in names))
    return (F.size(families) == 2) & has("GPL") & has("Apache", "MIT", "MIT-style")


def translation_artifacts(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.contains(p), F.lit(p)) for p in TRANSLATED)))


def suspicious_patterns(text: Column) -> Column:
    """Array of (pattern, penalty): short text, reserved rights against a grant, unfilled template, pointer to another file."""
    low, size = F.lower(text), F.octet_length(text)
    grant = low.contains("permission is hereby granted") | low.contains("redistribution") | low.contains("free software") | low.contains("open source")
    found = [
        ((size < 100) & ~low.contains("unlicense") & ~low.contains("wtfpl"), "short", 0.20),
        (low.contains("all rights reserved") & grant, "reserved", 0.10),
        (low.contains("copyright (c) [year]") | low.contains("copyright (c) <year>"), "template", 0.10),
        ((low.contains("see license") | low.contains("see the license")) & (size < 500), "pointer", 0.0),
    ]
    return F.array_compact(F.array(*(F.when(when, F.struct(F.lit(name).alias("pattern"), F.lit(penalty).alias("penalty"))) for when, name, penalty in found)))


def analyse(files: DataFrame, declared: Column) -> DataFrame:
    """``files`` with all findings about each text and ``trust`` from 0 to 1; a null ``declared`` skips what compares with it."""
    text = F.col("text")
    parts = files.withColumns(
        {
            "declared": declared, "detected": licence_of_text(text), "anomalies": odd_count(text), "missing": missing_clauses(text, declared), "extra": extra_sections(text),
            "additions": custom_restrictions(text), "confused_with": version_confusion(text, declared), "families": families_in_text(text), "artifacts": translation_artifacts(text), "suspicious": suspicious_patterns(text),
        }
    )
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["penalty"])
    penalty = (
        0.15 * F.col("anomalies") + total("missing") + 0.10 * F.size("additions") + F.when(F.col("confused_with").isNotNull(), 0.30).otherwise(0.0)
        + F.when(is_chimera(F.col("families")), 0.40).when(mixed_pair(F.col("families")), 0.15).otherwise(0.0) + 0.05 * F.size("artifacts") + total("suspicious")
    )
    return parts.withColumns({"chimera": is_chimera(F.col("families")), "trust": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - penalty, 6)))})
