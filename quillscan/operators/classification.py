"""What licence a text is under: an SPDX directive or id, phrases of licences, and clauses, each with a confidence; the surest wins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound
from ..refdata_licences import LICENCES

# Marks before a directive, lines that may hold one.
MARKS = ["# ", "// ", "/* ", "* "]
DIRECTIVE_LINES = 50
# Confidence of a directive, of ids by count, of phrases by share.
DIRECTIVE, ID_BASE, ID_STEP, ID_MOST = 0.99, 0.7, 0.05, 0.95
PHRASE_BASE, PHRASE_SHARE, PHRASE_MOST = 0.5, 0.4, 0.9
# Clauses by name; each needs one text of every list.
CLAUSES = {
    "patent": [["patent"], ["grant"]],
    "copyleft": [["derivative work"], ["same license", "same terms"]],
    "network": [["interact with it remotely", "network server", "over a computer network"]],
    "attribution": [["copyright notice"], ["permission notice"]],
    "no warranty": [["as is"], ["without warranty"]],
}
# Clauses that must and must not stand, the licence they mean, confidence; the first that fits.
BY_CLAUSES = [
    (["network", "copyleft"], [], "AGPL-3.0-only", 0.75),
    (["copyleft", "patent"], [], "GPL-3.0-only", 0.7),
    (["copyleft"], ["patent"], "GPL-2.0-only", 0.65),
    (["patent", "attribution"], ["copyleft"], "Apache-2.0", 0.7),
    (["attribution", "no warranty"], ["copyleft", "patent"], "MIT", 0.6),
]

IDS = [spelling for row in LICENCES for spelling in row[7]]
#: Phrases, each with the first licence that has it and how many phrases that licence has.
PHRASES: dict[str, tuple[str, int]] = {}
for _row in LICENCES:
    for _phrase in _row[9]:
        PHRASES.setdefault(_phrase.lower(), (_row[0], len(_row[9])))


def earliest(phrases: list[str]) -> str:
    """A pattern that finds phrases in any case as a reader does who stops at the first end of any phrase, at the longest that ends there.

    A phrase that holds another one before its own end is never reached. Of the others the leftmost
    is also the first to end, so alternatives do.
    """
    low = list(dict.fromkeys(p.lower() for p in phrases))
    reached = [p for p in low if not any(q in p[:-1] for q in low)]
    return "(?i)(?:" + "|".join(re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", p) for p in reached) + ")"


def directive(text: Column) -> Column:
    """The first SPDX directive's expression that is not empty, in the first lines; null if none."""
    pattern = r"^(?:" + "|".join(m.replace("*", r"\*") for m in MARKS) + r")?SPDX-License-Identifier:([\s\S]*)$"
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    said = F.transform(F.slice(F.split(text, "\n"), 1, DIRECTIVE_LINES), lambda line: trim(F.regexp_replace(trim(F.regexp_extract(trim(line), pattern, 1)), r"(?:\*/)+$", "")))
    return F.try_element_at(F.filter(said, lambda x: x != ""), F.lit(1))


def _candidate(place: int, licence: Column, confidence: Column, method: str) -> Column:
    return F.struct((-confidence).alias("least"), F.lit(place).alias("place"), licence.alias("licence"), confidence.cast("double").alias("confidence"), F.lit(method).alias("method"))


def _by_id(text: Column) -> Column:
    """The id that stands most often, the earliest of those."""
    named = F.create_map(*(F.lit(v) for i in IDS for v in (i.lower(), i)))

    def most(hits: Column) -> Column:
        counted = bound(F.array_distinct(hits), lambda ids: F.transform(ids, lambda x, k: F.struct(F.size(F.filter(hits, lambda h: h == x)).alias("n"), (-k).alias("k"), x.alias("id"))))
        return F.array_max(counted)

    hits = F.transform(F.regexp_extract_all(text, F.lit(earliest(IDS)), F.lit(0)), F.lower)
    best = bound(hits, most)
    return bound(best, lambda b: F.when(b["n"].isNotNull(), _candidate(0, F.element_at(named, b["id"]), F.least(F.lit(ID_MOST), ID_BASE + b["n"] * ID_STEP), "SpdxIdentifier")))


def phrase_hits(text: Column) -> Column:
    """All phrases found, in lower case, without overlaps."""
    return F.transform(F.regexp_extract_all(text, F.lit(earliest(list(PHRASES))), F.lit(0)), F.lower)


def _by_phrases(hits: Column) -> list[Column]:
    out = []
    for place, row in enumerate(LICENCES, 1):
        own = [p for p, (licence, _) in PHRASES.items() if licence == row[0]]
        n = F.size(F.filter(hits, lambda h: h.isin(own)))
        if own:
            out.append(F.when(n > 0, _candidate(place, F.lit(row[0]), F.least(F.lit(PHRASE_MOST), PHRASE_BASE + n / F.lit(len(row[9])) * PHRASE_SHARE), "HeaderPattern")))
    return out


def clauses(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    any_of = lambda texts: reduce(lambda a, b: a | b, (low.contains(t) for t in texts))
    return {name: reduce(lambda a, b: a & b, map(any_of, lists)) for name, lists in CLAUSES.items()}


def _by_clauses(text: Column) -> Column:
    has, out = clauses(text), F.lit(None)
    for must, mustnt, licence, confidence in reversed(BY_CLAUSES):
        fits = reduce(lambda a, b: a & b, [*(has[c] for c in must), *(~has[c] for c in mustnt)])
        out = F.when(fits, _candidate(len(LICENCES) + 1, F.lit(licence), F.lit(confidence), "StructuralAnalysis")).otherwise(out)
    return out


def classified(text: Column) -> Column:
    """Struct ``licence, confidence, method, alternatives`` of a text; null if nothing hints at a licence.

    Of equal confidence an id comes before phrases (in the order of the licence table), these before clauses. A null
    text has no licence. The whole text counts, but for directives, which stand in the first lines.
    """

    def of(text: Column) -> Column:
        tag = bound(directive(text), lambda t: F.when(t.isNotNull(), _candidate(0, t, F.lit(DIRECTIVE), "SpdxIdentifier")).otherwise(_by_id(text)))
        found = bound(phrase_hits(text), lambda hits: F.array(tag, *_by_phrases(hits), _by_clauses(text)))
        return F.array_sort(F.array_compact(found))

    best = lambda c: F.when(
        F.size(c) > 0,
        F.struct(c[0]["licence"].alias("licence"), c[0]["confidence"].alias("confidence"), c[0]["method"].alias("method"), F.transform(F.slice(c, F.lit(2), F.size(c)), lambda x: F.struct(x["licence"].alias("licence"), x["confidence"].alias("confidence"))).alias("alternatives")),
    )
    return bound(bound(text, of), best)
