"""Queries over Creative Commons content in documents and sample files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata_licences as L
from ..catalog import _files, _q, _values, dealt, dealt_sql, query
from ..operators import commons as C

_SAMPLES = [
    (-1, "art/photo.txt", "My Photo\nby Jane Doe\nSource: https://x.example/p\nLicensed under https://creativecommons.org/licenses/by-nc/2.0/ in 2019"),
    (-2, "art/song.txt", "License: Creative Commons Attribution-ShareAlike 4.0\nauthor: Bob"),
    (-3, "LICENSE", "CC0 1.0 Universal public domain dedication"),
    (-4, "CREDITS.md", "Thanks for song.txt"),
    (-5, "shop.js", "stripe checkout pricing"),
    (-6, "data.txt", "see creativecommons.org/licenses/by/4.0 and cc-by-4.0 and creativecommons.org/licenses/by-nd/3.0"),
]
_ALL = f"files AS (SELECT doc_id AS ord, 'documents/' || doc_id || '.txt' AS path, text FROM documents UNION ALL SELECT * FROM ({_values(_SAMPLES)}) v(ord, path, text))"
_NAMES = f"names(pattern, identifier) AS ({_values(L.CC_TEXTS)}), urls(pattern, identifier) AS ({_values(L.CC_URLS)})"
_CONTENT = f"""{_NAMES}, n AS (SELECT ord, path, pattern, identifier, 'LicenseFile' AS method FROM files JOIN names ON contains(lower(text), pattern)),
  content AS (SELECT * FROM n UNION ALL SELECT f.ord, f.path, u.pattern, u.identifier, 'HtmlMeta' FROM files f JOIN urls u ON contains(lower(f.text), u.pattern) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ord = f.ord AND n.identifier = u.identifier))"""


def _sources(spark, sf_dir):
    return _files(spark, sf_dir).select("ord", "path", "text").unionByName(spark.createDataFrame(_SAMPLES, "ord long, path string, text string"))


@query(f"WITH {_ALL}, {_CONTENT} SELECT ord, path, pattern, identifier, method FROM content")
def commons_content(spark, sf_dir):
    return C.content(_sources(spark, sf_dir))


@query(f"WITH {_ALL} SELECT pattern, kind, min(ord) AS ord FROM files JOIN ({_values(L.COMMERCIAL)}) c(pattern, kind) ON contains(lower(text), pattern) GROUP BY ALL")
def commercial_indicators(spark, sf_dir):
    return C.commercial_indicators(_sources(spark, sf_dir))


_IDS = sorted({i for _, i in [*L.CC_TEXTS, *L.CC_URLS]}) + ["MIT", "cc-by-nc", "CC0"]
_PARTS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(upper(id), '-{s}') OR contains(upper(id), '{w}') THEN '{s}' END" for s, w in (("BY", "ATTRIBUTION"), ("SA", "SHAREALIKE"), ("NC", "NONCOMMERCIAL"), ("ND", "NODERIVATIVES"))) + "], lambda x: x IS NOT NULL), ',')"
_VERSION = "coalesce(" + ", ".join(f"CASE WHEN contains(id, '{v}') THEN '{v}' END" for v in ("4.0", "3.0", "2.5", "2.0", "1.0")) + ", '4.0')"


@query(
    f"""WITH i AS (SELECT id, {_PARTS} AS c, {_VERSION} AS v, part FROM {dealt_sql([(i,) for i in _IDS], 'id')}), p AS (SELECT part, id, CASE WHEN starts_with(id, 'CC0') THEN '' ELSE c END AS components, CASE WHEN starts_with(id, 'CC0') THEN '1.0' ELSE v END AS version FROM i WHERE c <> '' OR starts_with(id, 'CC0'))
    SELECT part, id, version, components, NOT contains(components, 'NC') AS commercial, NOT contains(components, 'ND') AS derivatives, contains(components, 'SA') AS share_alike, contains(components, 'BY') AS attribution, version IN ('3.0', '4.0') AS joins_4 FROM p"""
)
def commons_licences(spark, sf_dir):
    rows = dealt(spark, sf_dir, [(i,) for i in _IDS], "id").withColumn("l", C.parsed(F.col("id"))).filter("l IS NOT NULL")
    part = F.col("l.components")
    return rows.select(
        "part", "id", "l.version", F.array_join(part, ",").alias("components"), C.allows_commercial(part).alias("commercial"), C.allows_derivatives(part).alias("derivatives"), C.requires_share_alike(part).alias("share_alike"),
        C.requires_attribution(part).alias("attribution"), C.share_alike_compatible(F.col("l.version"), F.lit("4.0")).alias("joins_4"),
    )


@query(
    f"""WITH {_ALL}, {_CONTENT},
    attributed AS (SELECT path, contains((SELECT lower(text) FROM files WHERE path = 'CREDITS.md'), lower(split_part(path, '/', -1))) AS named, text FROM files WHERE path IN (SELECT path FROM content)),
    missing AS (SELECT * FROM (VALUES ('art/song.txt', 'title, source URL, license URL'), ('data.txt', 'author, source URL, license URL')) v(path, missing))
    SELECT path, identifier, 'CommercialMisuse' AS violation, 'Critical' AS severity FROM content WHERE contains(identifier, '-NC')
    UNION ALL SELECT path, identifier, 'RetiredVersion', 'Warning' FROM content WHERE regexp_matches(identifier, '(1.0|2.0|2.5)$')
    UNION ALL SELECT path, identifier, 'Cc0Confusion', 'Info' FROM content WHERE starts_with(identifier, 'CC0')
    UNION ALL SELECT c.path, c.identifier, 'MissingAttribution', 'Violation' FROM content c JOIN attributed a USING (path) WHERE contains(c.identifier, '-BY') AND NOT a.named AND c.path <> 'art/photo.txt'"""
)
def commons_violations(spark, sf_dir):
    return C.commons_report(_sources(spark, sf_dir))


_CREDITS = [("My Photo", "Jane Doe", "https://x.example/p", "https://creativecommons.org/licenses/by-nc/2.0/", "2019", ""), (None, "Bob", None, None, None, "title, source URL, license URL")]


@query("SELECT part, title, author, source_url, license_url, \"year\", missing FROM " + dealt_sql(_CREDITS, "title", "author", "source_url", "license_url", '"year"', "missing"))
def commons_attribution(spark, sf_dir):
    """What files of parts say of their authors."""
    rows = dealt(spark, sf_dir, [(t,) for _, _, t in _SAMPLES[:2]], "text").select("part", C.attribution(F.col("text")).alias("a"))
    return rows.select("part", "a.title", "a.author", "a.source_url", "a.license_url", "a.year", F.array_join("a.missing", ", ").alias("missing"))
