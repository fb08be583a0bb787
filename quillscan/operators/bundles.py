"""Libraries inside script bundles: which ones, which version, which bytes, and whether their authors are still named.

Every text is read once: an automaton finds the first place of all known texts at the same time, and patterns of
versions run only for libraries that are there. What a library covers reaches from the declaration before its first
known text to the end of the block after its last one; ranges of several libraries may overlap, so the bytes that are
somebody else's are those of the ranges' union.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import slices
from ..refdata_bundles import ALL_RIGHTS, ATTRIBUTION_FILES, BUNDLE_EXTENSIONS, CLAIM, LIBRARIES
from . import deobfuscation

#: Most bytes of signature files; they are broadcast.
SIGNATURE_BYTES = 16_000_000
#: How far behind its last known text a library's end is looked for, and where it ends without one.
REACH, TAIL = 5000, 1000


@dataclass(frozen=True)
class Signature:
    name: str
    author: str
    licence: str
    family: str
    least_hits: int
    notice: str
    #: Known texts: the text, what it is, confidence. Places of ``numbers`` carry no line.
    texts: tuple[tuple[str, str, float], ...]
    numbers: tuple[tuple[str, str, float], ...] = ()
    versions: tuple[str, ...] = ()
    restriction: str | None = None


#: What the fixed values know.
KNOWN = [Signature(*row[:6], *(tuple((text, text, c) for text, c in part) for part in row[6:8]), tuple(row[8]), row[9]) for row in LIBRARIES]

#: Families by their name in signature files; what is not listed counts as permissive.
FAMILIES = ("permissive", "permissive_notice", "weak_copyleft", "strong_copyleft", "commercial_restricted", "source_available", "proprietary")


def parse_signatures(toml: str) -> list[Signature]:
    """Signatures of a TOML text with ``[[lib]]`` tables."""
    out = []
    for lib in tomllib.loads(toml).get("lib", []):
        family = lib["family"] if lib["family"] in FAMILIES else "permissive"
        texts = tuple((s["p"], s["d"], float(s["c"])) for s in lib.get("strings", []))
        numbers = tuple((s["v"], s["d"], float(s["c"])) for s in lib.get("constants", []))
        out.append(Signature(lib["name"], lib["author"], lib["license"], family, lib["min_hits"], lib["copyright"], texts, numbers, tuple(v["r"] for v in lib.get("versions", [])), lib.get("commercial_restriction")))
    return out


def load_signatures(spark: SparkSession, path: str) -> list[Signature]:
    """Signatures of the TOML files at ``path``; files of more than ``SIGNATURE_BYTES`` together are an error."""
    files = spark.read.text(path, wholetext=True)
    size = files.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > SIGNATURE_BYTES:
        raise ValueError(f"signature files of {size} bytes; at most {SIGNATURE_BYTES} are read")
    return [s for row in files.orderBy("value").collect() for s in parse_signatures(row.value)]


# ---------------------------------------------------------------- one text


def first_places(text: str, automaton: ahocorasick.Automaton | None) -> dict[int, int]:
    """Where each known text, by its number, stands first."""
    first: dict[int, int] = {}
    if automaton is not None:
        for end, numbers in automaton.iter(text):
            for k, size in numbers:
                first.setdefault(k, end - size + 1)
    return first


def _bytes_and_lines(text: str, places: Iterable[int]) -> dict[int, tuple[int, int]]:
    """Byte offset and line of places in a text, in one walk."""
    out, at, size, line = {}, 0, 0, 1
    for place in sorted(set(places)):
        between = text[at:place]
        size, line, at = size + len(between.encode("utf-8", "surrogatepass")), line + between.count("\n"), place
        out[place] = (size, line)
    return out


def covered(text: str, first: int, last: int) -> tuple[int, int]:
    """The characters that a library with known texts at ``first`` to ``last`` reaches over; the end may lie behind the text."""
    start = next((at for word in ("var ", "function") if (at := text.rfind(word, 0, first)) >= 0), first)
    ahead = text[last : last + REACH].encode("utf-8", "surrogatepass")[:REACH].decode("utf-8", "ignore")
    end = next((last + at for word in (";var ", "}).call", "})(") if (at := ahead.find(word)) >= 0), last + TAIL)
    return start, end


def claims_of(text: str, claim: re.Pattern = re.compile(CLAIM), rights: re.Pattern = re.compile(ALL_RIGHTS)) -> list[dict]:
    """Who claims the text: a row per claim, with the line and the line's byte offset."""
    out, size = [], 0
    for number, line in enumerate(text.split("\n"), 1):
        for m in claim.finditer(line.removesuffix("\r")):
            out.append({"text": m[0], "holder": m[2].strip().rstrip("."), "year": m[1], "all_rights": rights.search(line) is not None, "at": size, "line": number})
        size += len(line.encode("utf-8", "surrogatepass")) + 1
    return out


_HIT = "struct<text string, at long, line int, what string, confidence double>"
_FOUND = f"array<struct<library int, hits array<{_HIT}>, version string, preserved boolean, start long, end long>>"
_CLAIMS = "array<struct<text string, holder string, year string, all_rights boolean, at long, line int>>"


class Searcher:
    """Looks for all signatures in a text at once."""

    def __init__(self, signatures: list[Signature]):
        self.signatures = signatures
        self.known = [(s, t, what, c, lined) for s, sig in enumerate(signatures) for lined, part in ((True, sig.texts), (False, sig.numbers)) for t, what, c in part if t]
        self.versions = [[re.compile(v) for v in sig.versions] for sig in signatures]
        by_text: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, *_rest) in enumerate(self.known):
            by_text.setdefault(t, []).append((k, len(t)))
        self.automaton = ahocorasick.Automaton() if by_text else None
        for t, numbers in by_text.items():
            self.automaton.add_word(t, numbers)
        if by_text:
            self.automaton.make_automaton()

    def libraries(self, text: str) -> list[dict]:
        first = first_places(text, self.automaton)
        by: dict[int, list[int]] = {}
        for k in sorted(first):
            by.setdefault(self.known[k][0], []).append(k)
        by = {s: ks for s, ks in sorted(by.items()) if len(ks) >= self.signatures[s].least_hits}
        ranges = {s: covered(text, min(first[k] for k in ks), max(first[k] for k in ks)) for s, ks in by.items()}
        inside = [min(p, len(text)) for r in ranges.values() for p in r]
        where = _bytes_and_lines(text, [*(first[k] for ks in by.values() for k in ks), *inside])
        out = []
        for s, ks in by.items():
            sig = self.signatures[s]
            hits = [{"text": self.known[k][1], "at": where[first[k]][0], "line": where[first[k]][1] if self.known[k][4] else None, "what": self.known[k][2], "confidence": self.known[k][3]} for k in ks]
            version = next((m[1] for v in self.versions[s] if (m := v.search(text)) and m.lastindex), None)
            start, end = (where[min(p, len(text))][0] + max(0, p - len(text)) for p in ranges[s])
            out.append({"library": s, "hits": hits, "version": version, "preserved": sig.notice in text or sig.author in text, "start": start, "end": end})
        return out


def _examined(signatures: list[Signature]):
    kept: list[Searcher] = []  # one per worker process

    @pandas_udf(f"struct<libraries: {_FOUND}, claims: {_CLAIMS}>")
    def examine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept.append(Searcher(signatures))
        for text, clean in batches:
            for part in slices(text):
                yield pd.DataFrame({"libraries": [kept[0].libraries(t) for t in clean.iloc[part]], "claims": [claims_of(t) for t in text.iloc[part]]})

    return examine


# ---------------------------------------------------------------- Spark


def folder(path: Column) -> Column:
    """What stands before the last slash (empty without one)."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What stands behind the last dot of the name (null for names without one, or with none but a first)."""
    return F.nullif(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1), F.lit(""))


def attributed_folders(files: DataFrame) -> DataFrame:
    """Folders that hold a file naming authors, each once."""
    return files.filter(file_name(F.col("path")).isin(ATTRIBUTION_FILES)).select(folder(F.col("path")).alias("_folder")).distinct()


def _union_length(ranges: Column) -> Column:
    """Length of the union of ``start, end`` ranges: sorted, each adds what lies behind all before it."""
    zero = F.struct(F.lit(0).cast("long").alias("length"), F.lit(0).cast("long").alias("upto"))
    step = lambda a, r: F.struct((a["length"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["upto"]))).alias("length"), F.greatest(a["upto"], r["end"]).alias("upto"))
    return F.aggregate(F.array_sort(ranges), zero, step, lambda a: a["length"])


def bundle_reports(files: DataFrame, signatures: list[Signature] | None = None, deobfuscate: bool = True) -> DataFrame:
    """A report per script, style sheet or page of ``path, text``, whole texts.

    ``libraries`` hold name, licence, family, author, restriction, version, confidence, known texts found with their places,
    byte range, percentage, and whether authors are still named; ``claims`` are who claims the text. ``third_party`` is the
    sum of the libraries' percentages (100 at most), ``foreign_bytes`` the union of their ranges within the file.
    Libraries are looked for in the de-obfuscated text, claims in the text as it is. A null text counts as empty; a null
    path is no script. Equal rows give equal reports.
    """
    signatures = KNOWN if signatures is None else signatures
    text = F.coalesce("text", F.lit(""))
    scripts = files.filter(extension(F.col("path")).isin(BUNDLE_EXTENSIONS)).select("path", text.alias("text"))
    scripts = deobfuscation.cleaned(scripts) if deobfuscate else scripts.withColumn("clean", F.col("text"))
    size = F.octet_length("text").cast("long")
    seen = scripts.select("path", F.sha2("text", 256).alias("sha256"), size.alias("size"), _examined(signatures)(F.col("text"), F.col("clean")).alias("_seen"), folder(F.col("path")).alias("_folder"))
    named = attributed_folders(files).withColumn("attributed", F.lit(True))
    seen = seen.join(named, "_folder", "left").withColumn("attributed", F.coalesce("attributed", F.lit(False)))
    about = F.array(*(F.struct(F.lit(s.name).alias("name"), F.lit(s.licence).alias("licence"), F.lit(s.family).alias("family"), F.lit(s.author).alias("author"), F.lit(s.restriction).cast("string").alias("restriction")) for s in signatures)) if signatures else F.from_json(F.lit("[]"), "array<struct<name string, licence string, family string, author string, restriction string>>")
    hits = lambda lib: F.transform(lib["hits"], lambda h: h["confidence"])
    mean = lambda lib: F.aggregate(hits(lib), F.lit(0.0), lambda a, c: a + c) / F.size(lib["hits"])
    percent = lambda lib: (lib["end"] - lib["start"]) / F.col("size") * 100

    def described(lib: Column) -> Column:
        of = F.get(F.col("_about"), lib["library"])
        confidence = F.least(F.lit(1.0), F.array_max(hits(lib)) * 0.6 + mean(lib) * 0.4)
        return F.struct(*(of[c].alias(c) for c in ("name", "licence", "family", "author", "restriction")), lib["version"].alias("version"), confidence.alias("confidence"), lib["hits"].alias("hits"), lib["start"].alias("start"), lib["end"].alias("end"), percent(lib).alias("percentage"), lib["preserved"].alias("preserved"))

    out = seen.withColumn("_about", about).select("path", "sha256", "size", "attributed", F.transform("_seen.libraries", described).alias("libraries"), F.col("_seen.claims").alias("claims"))
    third = F.least(F.lit(100.0), F.aggregate("libraries", F.lit(0.0), lambda a, lib: a + lib["percentage"]))
    foreign = _union_length(F.transform("libraries", lambda lib: F.struct(lib["start"].alias("start"), F.least(lib["end"], F.col("size")).alias("end"))))
    stripped, claimed = F.exists("libraries", lambda lib: ~lib["preserved"]), F.exists("claims", lambda c: c["all_rights"])
    verdict = (
        F.when(claimed & stripped, "CopyrightFraud")
        .when(stripped | F.exists("libraries", lambda lib: lib["restriction"].isNotNull()), "LicenseViolation")
        .when((F.size("libraries") > 0) & ~F.col("attributed"), "AttributionIssues")
        .otherwise("Clean")
    )
    return out.withColumns({"third_party": third, "original": 100 - third, "foreign_bytes": foreign, "integrity": verdict})


def bundle_libraries(reports: DataFrame) -> DataFrame:
    """A row per script and library in it."""
    return reports.select("path", F.explode("libraries").alias("_lib")).select("path", "_lib.*")


def bundle_findings(reports: DataFrame) -> DataFrame:
    """``file, vtype, severity, confidence, library, evidence``: notices removed, authors unnamed, restricted use, rights claimed over others' code."""

    def finding(vtype: str, severity: str, confidence: Column, library: Column, evidence: Column) -> Column:
        return F.struct(F.lit(vtype).alias("vtype"), F.lit(severity).alias("severity"), confidence.alias("confidence"), library.cast("string").alias("library"), evidence.cast("string").alias("evidence"))

    blanket = F.filter("claims", lambda c: c["all_rights"])

    def of_library(lib: Column) -> Column:
        false = F.filter(blanket, lambda c: ~c["holder"].contains(lib["author"]) & (F.octet_length(c["holder"]) > 2) & ~lib["preserved"])
        unnamed = ~F.col("attributed") & lib["family"].isin("permissive", "permissive_notice")
        once = F.array(
            F.when(~lib["preserved"], finding("StrippedLicense", "High", lib["confidence"], lib["name"], lib["author"])),
            F.when(unnamed, finding("MissingAttribution", "High", lib["confidence"], lib["name"], lib["licence"])),
            F.when(lib["restriction"].isNotNull(), finding("CommercialUseViolation", "Critical", lib["confidence"], lib["name"], lib["restriction"])),
        )
        return F.concat(F.array_compact(once), F.transform(false, lambda c: finding("LicenseTextTampering", "Critical", lib["confidence"] * 0.95, lib["name"], c["holder"])))

    names = F.array_join(F.transform("libraries", lambda lib: F.concat(lib["name"], F.lit(" ("), lib["licence"], F.lit(")"))), ", ")
    over_all = F.when((F.size("libraries") > 0) & (F.size(blanket) > 0), finding("LicenseTextTampering", "Critical", F.lit(0.99), F.lit(None), names))
    found = F.concat(F.flatten(F.transform("libraries", of_library)), F.array_compact(F.array(over_all)))
    return reports.select(F.col("path").alias("file"), F.explode(found).alias("_f")).select("file", "_f.*")
