"""Web assets in pages, style sheets and scripts: delivery networks, fonts, icons, trackers, embedded data, source maps.

Inputs have ``key, text``.  Line detectors take texts apart only after a cheap test of the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..refdata_web import CDN_HOSTS, CDN_LICENCES, COMMERCIAL_FONTS, CSS_FRAMEWORKS, DATA_PREFIXES, GOOGLE_FONTS, ICONS, META_IMAGES, SCRAPERS, TRACKERS


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _lines(pages: DataFrame, words: list[str]) -> DataFrame:
    """``key, line_no, line, low`` of lines that hold one of ``words``."""
    rows = pages.filter(_any(F.lower("text"), words)).select("key", F.posexplode(lines(F.col("text"))).alias("no", "line"))
    return rows.select("key", (F.col("no") + 1).alias("line_no"), "line", F.lower("line").alias("low")).filter(_any(F.col("low"), words))


def _hits(line: Column, table: list[tuple], *names: str) -> Column:
    return F.array_compact(F.array(*(F.when(line.contains(r[0]), F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True)))) for r in table)))


def tag_url(line: Column) -> Column:
    """Value of the first attribute of src and href, double quotes before single ones; null if none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(line, rf"(?i){a}={q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'") for a in ("src", "href")))


def content_value(line: Column) -> Column:
    return F.coalesce(*(F.nullif(F.regexp_extract(line, rf"(?i)content={q}([^{q}]*){q}", 1), F.lit("")) for q in ('"', "'")))


def integrity(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r'(?i)integrity="([^"]*)"', 1), F.lit(""))


def cdn_library(url: Column) -> Column:
    """Library name in a delivery network's path; null if it has none."""
    parts = F.split(url, "/")
    versioned = F.regexp_extract(url, r"(?:^|/)([^/@]*)@[^/]*", 1)
    return (
        F.when(url.contains("cdnjs.cloudflare.com") & (F.size(parts) > 5), F.get(parts, F.lit(5)))
        .when(url.contains("cdn.jsdelivr.net") & url.contains("@"), versioned)
        .when(url.contains("unpkg.com") & (F.size(parts) > 3), F.split_part(F.get(parts, F.lit(3)), F.lit("@"), F.lit(1)))
    )


def cdn_version(url: Column) -> Column:
    """What follows the last @ if it begins with a digit, else the first path part that does and has a dot."""
    after = F.regexp_extract(url, r"@([0-9][^/@]*)(?:/[^@]*)?$", 1)
    found = F.filter(F.split(url, "/"), lambda p: p.rlike("^[0-9]") & p.contains("."))
    return F.when(after != "", after).otherwise(F.get(found, F.lit(0)))


def library_licence(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(*(F.when(low.contains(n), F.lit(v)) for n, v in CDN_LICENCES))


def resource_type(low: Column) -> Column:
    return F.when(_any(low, [".css", "stylesheet"]), "Css").when(_any(low, [".js", "script"]), "JavaScript").when(_any(low, [".woff", ".ttf", ".otf"]), "Font").otherwise("Other")


def cdn_references(pages: DataFrame) -> DataFrame:
    """``key, line_no, provider, url, library, version, licence, resource, integrity``: a row per line and host in it."""
    rows = _lines(pages, [h for h, _ in CDN_HOSTS]).withColumn("h", F.explode(_hits(F.col("low"), CDN_HOSTS, "host", "provider")))
    url = F.coalesce(tag_url(F.col("line")), F.lit(""))
    rows = rows.withColumn("url", url).withColumn("library", cdn_library(F.col("url")))
    return rows.select("key", "line_no", "h.provider", "url", "library", cdn_version(F.col("url")).alias("version"), library_licence(F.col("library")).alias("licence"), resource_type(F.col("low")).alias("resource"), integrity(F.col("line")).alias("integrity"))


def missing_integrity(pages: DataFrame) -> DataFrame:
    """References to scripts and styles of delivery networks without an integrity hash."""
    return cdn_references(pages).filter("integrity IS NULL AND resource IN ('Css', 'JavaScript')")


def hosted_fonts(pages: DataFrame) -> DataFrame:
    """``key, line_no, font, licence`` of hosted font families and of Adobe's font service."""
    rows = _lines(pages, ["fonts.googleapis.com", "fonts.gstatic.com"]).withColumn("url", tag_url(F.col("line"))).filter("url IS NOT NULL")
    families = F.transform(F.slice(F.split("url", "family="), F.lit(2), F.size(F.split("url", "family="))), lambda p: F.replace(F.split_part(F.split_part(p, F.lit("&"), F.lit(1)), F.lit(":"), F.lit(1)), F.lit("+"), F.lit(" ")))
    named = rows.select("key", "line_no", F.explode(families).alias("font")).filter("font <> ''")
    known = F.coalesce(*(F.when(F.lower("font") == n.lower(), F.lit(v)) for n, v in GOOGLE_FONTS), F.lit("OFL"))
    adobe = _lines(pages, ["use.typekit.net", "use.typekit.com"]).select("key", "line_no", F.lit("Adobe Fonts").alias("font"), F.lit("Commercial").alias("licence"))
    return named.select("key", "line_no", "font", known.alias("licence")).unionByName(adobe)


def meta_images(pages: DataFrame) -> DataFrame:
    """``key, kind, url`` of images named in page heads."""
    rows = _lines(pages, [m for m, _ in META_IMAGES]).withColumn("m", F.explode(_hits(F.col("low"), META_IMAGES, "mark", "kind")))
    return rows.select("key", "m.kind", content_value(F.col("line")).alias("url")).filter("url IS NOT NULL")


def icon_libraries(pages: DataFrame) -> DataFrame:
    """``key, library, tier, references``: a pro class among a page's makes the library pro."""
    rows = _lines(pages, [i for i, _, _ in ICONS]).select("key", F.explode(_hits(F.col("low"), ICONS, "mark", "library", "tier")).alias("i"))
    return rows.groupBy("key", "i.library").agg(F.when(F.bool_or(F.col("i.tier") == "Pro"), "Pro").otherwise("Free").alias("tier"), F.count("*").alias("references"))


def trackers(pages: DataFrame) -> DataFrame:
    """``key, provider, concern`` of tracking scripts, each once a page; texts are compared in lower case."""
    low = F.lower("text")
    return pages.select("key", F.explode(_hits(low, TRACKERS, "host", "provider", "concern")).alias("t")).select("key", "t.provider", "t.concern").distinct()


def css_frameworks(sheets: DataFrame) -> DataFrame:
    """``framework, licence, version, key``: each framework with the first sheet that shows it."""
    low = F.lower("text")
    found = sheets.select("key", "text", F.explode(_hits(low, CSS_FRAMEWORKS, "mark", "framework", "licence")).alias("f"))
    return found.groupBy("f.framework", "f.licence").agg(F.min_by(comment_version(F.col("text")), "key").alias("version"), F.min("key").alias("key"))


def comment_version(text: Column) -> Column:
    """Digits and dots after the first v (or version) of the first 500 characters; null where the first v has none."""
    head = F.lower(F.left(text, F.lit(500)))
    first = F.regexp_extract(head, r"^[^v]*(v(?:ersion)?[ ]?[0-9.]*)", 1)
    return F.nullif(F.regexp_extract(first, r"([0-9][0-9.]*)$", 1), F.lit(""))


def font_faces(sheets: DataFrame) -> DataFrame:
    """``key, font, origin, licence`` of each @font-face block."""
    block = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"@font-face[^}]*\}"), F.lit(0)))
    rows = sheets.filter(F.lower("text").contains("@font-face")).select("key", block.alias("b"))
    rows = rows.withColumn("font", F.trim(F.translate(css_value(F.col("b"), "font-family"), "'\"", "")))
    origin = F.when(_any(F.col("b"), ["fonts.googleapis.com", "fonts.gstatic.com"]), "GoogleFonts").when(F.col("b").contains("use.typekit."), "AdobeFonts").when(F.col("b").contains("url("), "FontFaceUrl").when(F.col("b").contains("local("), "FontFaceLocal").otherwise("Bundled")
    rows = rows.select("key", F.coalesce("font", F.lit("Unknown")).alias("font"), origin.alias("origin"))
    licence = F.when(F.col("origin") == "GoogleFonts", "OFL").when((F.col("origin") == "AdobeFonts") | is_commercial_font(F.col("font")), "Commercial")
    return rows.select("key", "font", "origin", licence.alias("licence"))


def css_value(css: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(css, rf"{name}:([^;}}]*)", 1)), F.lit(""))


def css_url(css: Column) -> Column:
    return F.nullif(F.regexp_extract(css, r"url\(['\"]*([^)'\"]*)", 1), F.lit(""))


def is_commercial_font(name: Column) -> Column:
    return _any(F.lower(name), [f.lower() for f in COMMERCIAL_FONTS])


def in_comment(css: Column, word: Column) -> Column:
    """Whether the first place of ``word`` lies in a comment that is open there."""
    before = F.left(css, F.position(word, css) - 1)
    return F.regexp_replace(before, r"(?s)/\*.*?\*/", "").contains("/*")


def commercial_fonts(sheets: DataFrame) -> DataFrame:
    """``key, font`` of commercial fonts that a sheet with font families names outside comments."""
    low = F.lower("text")
    names = F.array_compact(F.array(*(F.when(low.contains(f.lower()) & ~in_comment(low, F.lit(f.lower())), F.lit(f)) for f in COMMERCIAL_FONTS)))
    return sheets.filter(low.contains("font-family")).select("key", F.explode(names).alias("font"))


def embedded_assets(sheets: DataFrame) -> DataFrame:
    """``key, mime, size`` of data URLs whose base64 text is longer than 1,000 characters."""
    pattern = r"(?i)(" + "|".join(p.replace("+", r"\+") for p in DATA_PREFIXES) + r")[^\"')]*"
    rows = sheets.filter(F.lower("text").contains(";base64,")).select("key", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("d"))
    size = F.length("d") - F.length(F.regexp_extract("d", r"^[^,]*,", 0))
    return rows.filter(size > 1000).select("key", F.lower(F.regexp_extract("d", "(?i)^data:([^;]*);", 1)).alias("mime"), F.floor(size * 3 / 4).cast("long").alias("size"))


def _scrapers(low: Column) -> Column:
    uses = lambda lib: _any(low, [f"{word}{q}{lib}{q}" for q in "'\"" for word in ("require(", "from ", "import ")])
    return F.array_compact(F.array(*(F.when(uses(lib), F.lit(lib)) for lib in SCRAPERS)))


def scraping_libraries(scripts: DataFrame) -> DataFrame:
    """``key, library`` of scraping libraries that a script requires or imports."""
    return scripts.select("key", F.explode(_scrapers(F.lower("text"))).alias("library"))


def robots_findings(scripts: DataFrame) -> DataFrame:
    """``finding, scripts``: libraries used, code that passes by robots.txt, and scraping without any code that heeds it."""
    low = F.lower("text")
    flags = scripts.agg(
        F.count_if(low.contains("robots") & _any(low, ["ignore", "bypass", "skip"])).alias("IgnoresRobots"),
        F.count_if(_any(low, ["robots.txt", "robotstxt", "robots_parser", "robotparser"])).alias("heeds"),
        F.coalesce(F.sum(F.size(_scrapers(low))), F.lit(0)).cast("long").alias("UsesScrapingLibrary"),
    )
    alone = F.when((F.col("UsesScrapingLibrary") > 0) & (F.col("IgnoresRobots") == 0) & (F.col("heeds") == 0), 1).otherwise(0).cast("long")
    out = flags.withColumn("ScraperWithoutRobotsCheck", alone).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, _ROBOTS)), F.array(*_ROBOTS))).alias("finding", "scripts"))
    return out.filter("scripts > 0")


_ROBOTS = ["UsesScrapingLibrary", "IgnoresRobots", "ScraperWithoutRobotsCheck"]


def source_maps(maps: DataFrame) -> DataFrame:
    """``key, sources, third_party`` of source maps: how many sources, and how many of others."""
    rows = maps.select("key", F.from_json("text", "sources array<string>").alias("m")).filter("m.sources IS NOT NULL")
    return rows.select("key", F.size("m.sources").alias("sources"), F.size(F.filter("m.sources", lambda s: _any(s, ["node_modules", "vendor", "bower_components"]))).alias("third_party"))
