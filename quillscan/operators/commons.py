"""Creative Commons: licences named in texts, what they allow, attribution, commercial use, violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..refdata_licences import CC_TEXTS, CC_URLS, COMMERCIAL, CREDIT_FILES
from ..sources.files import file_name


def parsed(identifier: Column) -> Column:
    """Struct ``identifier, version, components`` of a licence id; null if it names no Creative Commons licence."""
    up = F.upper(identifier)
    version = F.coalesce(*(F.when(up.contains(v), F.lit(v)) for v in ("4.0", "3.0", "2.5", "2.0", "1.0")), F.lit("4.0"))
    tests = [("BY", up.contains("-BY") | up.contains("ATTRIBUTION")), ("SA", up.contains("-SA") | up.contains("SHAREALIKE")), ("NC", up.contains("-NC") | up.contains("NONCOMMERCIAL")), ("ND", up.contains("-ND") | up.contains("NODERIVATIVES"))]
    parts = F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))
    zero = F.struct(F.lit("CC0-1.0").alias("identifier"), F.lit("1.0").alias("version"), F.array().cast("array<string>").alias("components"))
    return F.when(up.startswith("CC0"), zero).when(F.size(parts) > 0, F.struct(identifier.alias("identifier"), version.alias("version"), parts.alias("components")))


def allows_commercial(components: Column) -> Column:
    return ~F.array_contains(components, "NC")


def allows_derivatives(components: Column) -> Column:
    return ~F.array_contains(components, "ND")


def requires_share_alike(components: Column) -> Column:
    return F.array_contains(components, "SA")


def requires_attribution(components: Column) -> Column:
    return F.array_contains(components, "BY")


def share_alike_compatible(a: Column, b: Column) -> Column:
    """Whether works under two share-alike versions may be joined."""
    return (a == b) | (a.isin("3.0", "4.0") & b.isin("3.0", "4.0"))


def content(files: DataFrame) -> DataFrame:
    """``ord, path, pattern, identifier, method``: a row per licence text found, and per licence URL whose id no text or earlier URL of the file gave."""
    low = F.lower("text")
    names = F.array_compact(F.array(*(F.when(low.contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(i).alias("identifier"), F.lit("LicenseFile").alias("method"))) for p, i in CC_TEXTS)))
    urls = F.array_compact(F.array(*(F.when(low.contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(i).alias("identifier"), F.lit("HtmlMeta").alias("method"))) for p, i in CC_URLS)))
    rows = files.filter(low.contains("creative commons") | low.contains("cc-by") | low.contains("cc0") | low.contains("creativecommons.org") | low.contains("public domain dedication"))
    both = rows.select("ord", "path", names.alias("n"), urls.alias("u")).withColumn("u", F.filter("u", lambda x: ~F.array_contains(F.col("n.identifier"), x["identifier"])))
    return both.select("ord", "path", F.explode(F.concat("n", "u")).alias("c")).select("ord", "path", "c.*")


def attribution(text: Column) -> Column:
    """Struct ``title, author, source_url, license_url, year, missing`` from a text's lines."""
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.regexp_extract(text, r"(?im)^[ \t]*(?!by |author:|source:|#)(?![^\n]*creative commons)(?![^\n]*license)(\S[^\n]*)$", 1)
    author = last(r"(?im)^[ \t]*(?:author:|creator:|by )([^:\n]*)[^\n]*$")
    source = last(r"(?im)^[ \t]*(?:source|original|from):([^\n]*)$")
    url = last(r"(?i)(https?://[^\s\"'<>]*creativecommons\.org/licenses/[^\s\"'<>)]*)")
    parts = [("title", clean(title)), ("author", clean(author)), ("source URL", clean(source)), ("license URL", url)]
    missing = F.array_compact(F.array(*(F.when(c.isNull(), F.lit(n)) for n, c in parts)))
    return F.struct(parts[0][1].alias("title"), parts[1][1].alias("author"), parts[2][1].alias("source_url"), url.alias("license_url"), last(r"\b((?:19|20)[0-9]{2})\b").alias("year"), missing.alias("missing"))


def commercial_indicators(files: DataFrame) -> DataFrame:
    """``pattern, kind, ord``: each sign of commercial use with the first file that shows it."""
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(low.contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(k).alias("kind"))) for p, k in COMMERCIAL)))
    return files.select("ord", F.explode(found).alias("c")).groupBy("c.pattern", "c.kind").agg(F.min("ord").alias("ord"))


def credit_text(files: DataFrame) -> DataFrame:
    """At most one row ``path, text``: the first credit file by the list's order, else a README that gives credit."""
    name = file_name(F.col("path"))
    readme = ["README.md", "README", "README.txt", "README.rst"]
    low = F.lower("text")
    credit = low.contains("attribution") | low.contains("credits") | low.contains("acknowledgment") | low.contains("third-party")
    order = F.array(*(F.lit(n) for n in [*CREDIT_FILES, *readme]))
    rows = files.filter(name.isin(CREDIT_FILES) | (name.isin(readme) & credit)).filter("text <> ''")
    return rows.orderBy(F.array_position(order, name), "path").limit(1).select("path", "text")


def violations(found: DataFrame, commercial: Column) -> DataFrame:
    """``path, identifier, violation, severity`` of rows of :func:`content`; ``commercial``: whether the project is."""
    row = found.withColumn("l", parsed(F.col("identifier")))
    rules = [
        (commercial & ~allows_commercial(F.col("l.components")), "CommercialMisuse", "Critical"),
        (F.col("l.version").isin("1.0", "2.0", "2.5"), "RetiredVersion", "Warning"),
        (F.col("l.identifier").startswith("CC0"), "Cc0Confusion", "Info"),
    ]
    hits = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(n).alias("violation"), F.lit(s).alias("severity"))) for t, n, s in rules)))
    return row.select("path", "identifier", F.explode(hits).alias("v")).select("path", "identifier", "v.*")


def unattributed(files: DataFrame, found: DataFrame) -> DataFrame:
    """``path, identifier, missing`` of content that asks for attribution, is not named in the credit file and lacks elements.

    The credit file is one row, so its join is a broadcast of one text.
    """
    credit = credit_text(files).select(F.lower("text").alias("_credit"))
    rows = found.filter(requires_attribution(parsed(F.col("identifier"))["components"])).join(files.select("path", attribution(F.col("text")).alias("a")), "path")
    both = rows.join(F.broadcast(credit), F.lit(True), "left").filter(F.col("_credit").isNull() | ~F.col("_credit").contains(F.lower(file_name(F.col("path")))))
    return both.filter(F.size("a.missing") > 0).select("path", "identifier", F.array_join("a.missing", ", ").alias("missing"))


def commons_report(files: DataFrame) -> DataFrame:
    """All violations of a project's files: misuse, old versions, missing attribution."""
    found = content(files)
    commercial = commercial_indicators(files).limit(1).count() > 0
    missing = unattributed(files, found).select("path", "identifier", F.lit("MissingAttribution").alias("violation"), F.lit("Violation").alias("severity"))
    return reduce(DataFrame.unionByName, [violations(found, F.lit(commercial)), missing])
