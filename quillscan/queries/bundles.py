"""Pages that ship libraries, some with their authors' notices and some without; the SQL searches the same pages one known text at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import _q, _values, query
from ..operators import bundles as B
from ..refdata_bundles import ALL_RIGHTS, ATTRIBUTION_FILES, CLAIM

#: Libraries that pages ship: each in the pages whose number leaves ``rest`` by ``by``, with as many known texts as the number allows.
SHIPPED = [("jQuery", 2, 0), ("Lodash", 3, 1), ("RxJS", 5, 2), ("CryptoJS", 7, 3), ("FuzzySet.js", 4, 3), ("GPL-licensed code marker", 11, 4)]
_BY_NAME = {s.name: s for s in B.KNOWN}


def _texts(sig: B.Signature) -> str:
    """SQL of the first known texts of a library, declared one by one; ends that the range search looks for come and go."""
    parts = [f"CASE WHEN page_id % {len(sig.texts) + 1} >= {k} THEN 'f({k}, \"{t}\");' || repeat('y', CAST(page_id % {37 + k} AS INT)) ELSE '' END" for k, (t, _, _) in enumerate(sig.texts) if "'" not in t]
    parts += [f"CASE WHEN page_id % 2 = 0 THEN ' +{t} ' ELSE '' END" for t, _, _ in sig.numbers[:4]]
    return " || ".join(parts)


def _block(name: str, by: int, rest: int) -> str:
    sig = _BY_NAME[name]
    notice = f"CASE WHEN page_id % 4 = 1 THEN '/*! by {sig.author} */' ELSE '' END"
    return f"CASE WHEN page_id % {by} = {rest} THEN 'var m' || CAST(page_id AS STRING) || '=1;' || {notice} || {_texts(sig)} || CASE WHEN page_id % 3 = 0 THEN 'g()}})(m);' WHEN page_id % 3 = 1 THEN 'h();var z=2;' ELSE '' END ELSE '' END"


_NEWLINE = "'\n'"
#: The text of a page with its libraries, in SQL that Spark and DuckDB share.
PAGE = f" || {_NEWLINE} || ".join(
    [
        "html",
        "CASE WHEN page_id % 6 = 1 THEN '/* Copyright 2019-2021 Acme ' || CAST(page_id AS STRING) || ' Inc. All rights reserved. */' WHEN page_id % 6 = 2 THEN '// (c) Jeff Mott, all  RIGHTS reserved; COPYRIGHT 2020 , Someone é. */' ELSE '' END",
        "CASE WHEN page_id % 2 = 0 THEN 'jQuery v3.' || CAST(page_id % 7 AS STRING) || '.1' ELSE '' END",
        *(_block(*s) for s in SHIPPED),
        "'</script>'",
    ]
)
_SITE = "'site/' || CAST(page_id AS STRING)"


def sites(spark, sf_dir):
    """``path, text``: a page per row of ``pages``, and a licence file beside every third."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").filter("page_id IS NOT NULL")
    page = pages.select(F.expr(f"{_SITE} || '/index.html'").alias("path"), F.expr(PAGE).alias("text"))
    licence = pages.filter("page_id % 3 = 0").select(F.expr(f"{_SITE} || '/{ATTRIBUTION_FILES[0]}'").alias("path"), F.lit("MIT License").alias("text"))
    return page.unionByName(licence)


_SIG = _values([(s, g.name, g.author, g.licence, g.family, g.least_hits, g.notice, g.restriction) for s, g in enumerate(B.KNOWN)])
_TEXTS = _values([(s, k, lined, t, float(c)) for s, g in enumerate(B.KNOWN) for k, (lined, (t, _, c)) in enumerate([(True, x) for x in g.texts] + [(False, x) for x in g.numbers])])
_VERSIONS = _values([(s, k, v) for s, g in enumerate(B.KNOWN) for k, v in enumerate(g.versions)])
_SQL = f"""WITH files AS MATERIALIZED (SELECT {_SITE} || '/index.html' AS path, page_id, {PAGE} AS text FROM pages WHERE page_id IS NOT NULL),
sig(s, name, author, licence, family, least, notice, restriction) AS ({_SIG}), known(s, k, lined, t, c) AS ({_TEXTS}), versions(s, k, v) AS ({_VERSIONS}),
hit AS MATERIALIZED (SELECT path, s, k, lined, t, c, strpos(text, t) - 1 AS pos FROM files, known WHERE contains(text, t)),
grp AS MATERIALIZED (SELECT path, s, count(*) AS n, max(c) * 0.6 + avg(c) * 0.4 AS conf, min(pos) AS lo, max(pos) AS hi FROM hit JOIN sig USING (s) GROUP BY path, s HAVING count(*) >= any_value(least)),
reach AS (SELECT g.*, text, substr(text, 1, lo) AS before, substr(text, hi + 1) AS ahead FROM grp g JOIN files USING (path)),
ends AS (SELECT *, CASE WHEN contains(before, 'var ') THEN lo - length(string_split(before, 'var ')[-1]) - 4 WHEN contains(before, 'function') THEN lo - length(string_split(before, 'function')[-1]) - 8 ELSE lo END AS a,
  CASE WHEN contains(ahead, ';var ') THEN hi + strpos(ahead, ';var ') - 1 WHEN contains(ahead, '}}).call') THEN hi + strpos(ahead, '}}).call') - 1 WHEN contains(ahead, '}})(') THEN hi + strpos(ahead, '}})(') - 1 ELSE hi + 1000 END AS z FROM reach),
lib AS MATERIALIZED (SELECT path, s, name, licence, family, author, restriction, n, conf, strlen(substr(text, 1, a)) AS first_byte, strlen(substr(text, 1, z)) + greatest(0, z - length(text)) AS last_byte, strlen(text) AS size,
  contains(text, notice) OR contains(text, author) AS preserved, (SELECT first(regexp_extract(text, v, 1) ORDER BY k) FROM versions w WHERE w.s = ends.s AND regexp_matches(text, v)) AS version FROM ends JOIN sig USING (s)),
lines AS (SELECT path, unnest(string_split(text, {_NEWLINE})) AS line, generate_subscripts(string_split(text, {_NEWLINE}), 1) AS i FROM files),
placed AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM lines),
claim AS MATERIALIZED (SELECT path, i, pos, regexp_matches(line, {_q(ALL_RIGHTS)}) AS all_rights, unnest(regexp_extract_all(line, {_q(CLAIM)}, 0)) AS text, unnest(regexp_extract_all(line, {_q(CLAIM)}, 1)) AS year, rtrim(trim(unnest(regexp_extract_all(line, {_q(CLAIM)}, 2))), '.') AS holder FROM placed WHERE regexp_matches(line, {_q(CLAIM)})),
report AS (SELECT f.path, sha256(text) AS sha256, strlen(text) AS size, page_id % 3 = 0 AS attributed, (SELECT count(*) FROM lib l WHERE l.path = f.path) AS n_libraries, (SELECT count(*) FROM claim c WHERE c.path = f.path) AS n_claims,
  (SELECT coalesce(sum((last_byte - first_byte) / size::DOUBLE * 100), 0) FROM lib l WHERE l.path = f.path) AS share, (SELECT coalesce(bool_or(NOT preserved), false) FROM lib l WHERE l.path = f.path) AS stripped,
  (SELECT count(restriction) > 0 FROM lib l WHERE l.path = f.path) AS restricted, (SELECT coalesce(bool_or(all_rights), false) FROM claim c WHERE c.path = f.path) AS claimed FROM files f),
cover AS (SELECT path, sum(greatest(0, z - greatest(a, coalesce(m, 0)))) AS foreign_bytes FROM (SELECT path, first_byte AS a, least(last_byte, size) AS z, max(least(last_byte, size)) OVER (PARTITION BY path ORDER BY first_byte, last_byte, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lib) GROUP BY path)
"""


def _reports(spark, sf_dir):
    return B.bundle_reports(sites(spark, sf_dir))


@query(_SQL + "SELECT path, name, licence, version, CAST(n AS INTEGER) AS n_hits, round(conf, 6) AS confidence, CAST(first_byte AS BIGINT) AS first_byte, CAST(last_byte AS BIGINT) AS last_byte, round((last_byte - first_byte) / size::DOUBLE * 100, 6) AS percentage, preserved FROM lib")
def bundle_libraries(spark, sf_dir):
    """Libraries in pages: version, confidence, bytes, and whether their authors are named."""
    lib = B.bundle_libraries(_reports(spark, sf_dir))
    return lib.select("path", "name", "licence", "version", F.size("hits").alias("n_hits"), F.round("confidence", 6).alias("confidence"), F.col("start").alias("first_byte"), F.col("end").alias("last_byte"), F.round("percentage", 6).alias("percentage"), "preserved")


@query(_SQL + f"SELECT h.path, name, t AS known, CAST(strlen(substr(text, 1, pos)) AS BIGINT) AS byte, CASE WHEN lined THEN CAST(len(string_split(substr(text, 1, pos), {_NEWLINE})) AS INTEGER) END AS line FROM hit h JOIN grp USING (path, s) JOIN sig USING (s) JOIN files USING (path)")
def bundle_hits(spark, sf_dir):
    """Every known text of a library that is there, with its first byte and line."""
    lib = B.bundle_libraries(_reports(spark, sf_dir))
    return lib.select("path", "name", F.explode("hits").alias("h")).select("path", "name", F.col("h.text").alias("known"), F.col("h.at").alias("byte"), "h.line")


@query(_SQL + "SELECT path, text AS claim, holder, CASE WHEN year <> '' THEN year END AS year, all_rights, CAST(pos AS BIGINT) AS byte, CAST(i AS INTEGER) AS line FROM claim")
def bundle_claims(spark, sf_dir):
    """Who claims a page, line by line."""
    return _reports(spark, sf_dir).select("path", F.explode("claims").alias("c")).select("path", F.col("c.text").alias("claim"), "c.holder", "c.year", "c.all_rights", F.col("c.at").alias("byte"), "c.line")


@query(
    _SQL
    + """SELECT path, sha256, CAST(size AS BIGINT) AS size, attributed, CAST(n_libraries AS INTEGER) AS n_libraries, CAST(n_claims AS INTEGER) AS n_claims, round(least(100, share), 6) AS third_party, CAST(coalesce(foreign_bytes, 0) AS BIGINT) AS foreign_bytes,
  CASE WHEN claimed AND stripped THEN 'CopyrightFraud' WHEN stripped OR restricted THEN 'LicenseViolation' WHEN n_libraries > 0 AND NOT attributed THEN 'AttributionIssues' ELSE 'Clean' END AS integrity FROM report LEFT JOIN cover USING (path)"""
)
def bundle_reports(spark, sf_dir):
    """A verdict per page, with how much of it is others' code."""
    return _reports(spark, sf_dir).select("path", "sha256", "size", "attributed", F.size("libraries").alias("n_libraries"), F.size("claims").alias("n_claims"), F.round("third_party", 6).alias("third_party"), "foreign_bytes", "integrity")


@query(
    _SQL
    + """SELECT path AS file, 'StrippedLicense' AS vtype, 'High' AS severity, round(conf, 6) AS confidence, name AS library, author AS evidence FROM lib WHERE NOT preserved
  UNION ALL SELECT path, 'MissingAttribution', 'High', round(conf, 6), name, licence FROM lib JOIN report USING (path) WHERE NOT attributed AND family IN ('permissive', 'permissive_notice')
  UNION ALL SELECT path, 'CommercialUseViolation', 'Critical', round(conf, 6), name, restriction FROM lib WHERE restriction IS NOT NULL
  UNION ALL SELECT path, 'LicenseTextTampering', 'Critical', round(conf * 0.95, 6), name, holder FROM lib JOIN claim USING (path) WHERE NOT preserved AND all_rights AND NOT contains(holder, author) AND strlen(holder) > 2
  UNION ALL SELECT path, 'LicenseTextTampering', 'Critical', 0.99, NULL, (SELECT string_agg(name || ' (' || licence || ')', ', ' ORDER BY s) FROM lib l WHERE l.path = r.path) FROM report r WHERE n_libraries > 0 AND claimed"""
)
def bundle_findings(spark, sf_dir):
    """Notices removed, authors unnamed, restricted libraries, and rights claimed over others' code."""
    return B.bundle_findings(_reports(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
