"""Queries over licence texts, the licence table and policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from .. import refdata_licences as L
from ..catalog import _docs, _family_sql, _files, _licence_sql, _plain_sql, _q, _values, dealt, dealt_sql, query
from ..functions.license import licence_of_text
from ..operators import forensics, licences

#: Every document is held against one of these, by its id.
_DECLARED = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "AGPL-3.0-only", "BSD-3-Clause", "MPL-2.0", "LGPL-2.1-only", "ISC"]
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
#: Texts that show each finding, read besides the documents: id below 0, declared licence, text.
_SAMPLES = [
    (-1, "MIT", "Permission is hereby grаnted, free of charge​‮ to any person­"),
    (-2, "MIT", _GRANT + 'THE SOFTWARE IS PROVIDED "AS IS"'),
    (-3, "MIT", _GRANT + "Apache License. Under the terms of the GNU General Public License."),
    (-4, "GPL-2.0-only", "GNU General Public License\nVersion 3, 29 June 2007. The program is free."),
    (-5, "MIT", _GRANT + "\nNot for resale, personal use only.\nNon-compete applies.\nThe software sends telemetry.\nRestricted to the field of research. Addendum: rider."),
    (-6, "Apache-2.0", "Apache License, version 2.0. Copyright (c) [year]. All rights reserved. Redistribution is open source. See the license."),
    (-7, None, "Unlicense"),
    (-8, "GPL-3.0-only", "Under the terms of the GNU General Public License or the Apache License."),
    (-9, "LGPL-2.1-only", "lgpl-3.0 version 3 affero"),
]


def _texts(spark, sf_dir):
    names = F.array(*(F.lit(d) for d in _DECLARED))
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.element_at(names, (F.pmod("doc_id", F.lit(len(_DECLARED))) + 1).cast("int")).alias("declared"), "text")
    return docs.unionByName(spark.createDataFrame(_SAMPLES, "ord long, declared string, text string"))


_TEXTS = f"texts AS (SELECT doc_id AS ord, [{', '.join(map(_q, _DECLARED))}][doc_id % {len(_DECLARED)} + 1] AS declared, text FROM documents UNION ALL SELECT * FROM ({_values(_SAMPLES)}) v(ord, declared, text))"
_low = "lower(text)"
_ODD_SQL = f"(length(text) - length(translate(text, {_q(forensics.ODD)}, '')))"


def _list(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN {value} END" for when, value in tests) + "], lambda x: x IS NOT NULL)"


_KEY = "CASE " + " ".join(f"WHEN {w} THEN {_q(k)}" for w, k in [("contains(upper(declared), 'MIT')", "MIT"), ("contains(upper(declared), 'APACHE')", "APACHE"), ("contains(upper(declared), 'AGPL')", "AGPL"), ("contains(upper(declared), 'GPL') AND NOT contains(upper(declared), 'LGPL')", "GPL"), ("contains(upper(declared), 'BSD-3') OR contains(upper(declared), 'BSD3')", "BSD-3"), ("contains(upper(declared), 'MPL')", "MPL")]) + " END"
_CLAUSES = _values([(k, n, o, s.lower(), float(L.CLAUSE_PENALTIES.get(o, 0.05))) for k, n, o, s in L.CLAUSES] + [("AGPL", n, o, s.lower(), float(L.CLAUSE_PENALTIES.get(o, 0.05))) for k, n, o, s in L.CLAUSES if k == "GPL"])
_MISSING = f"missing AS (SELECT t.ord, c.clause, c.obligation, c.penalty FROM (SELECT *, {_KEY} AS key FROM texts) t JOIN ({_CLAUSES}) c(key, clause, obligation, snippet, penalty) ON c.key = t.key WHERE NOT contains({_low}, c.snippet))"
_CONFUSED = "coalesce(" + ", ".join(
    "CASE WHEN (" + " OR ".join(f"contains({_low}, {_q(m)})" for m in marks) + ") AND (" + " OR ".join(f"contains(upper(declared), {_q(f)})" for f in L.VERSION_FAMILIES if f in v.upper()) + f") AND NOT contains(upper(declared), {_q(v.upper())}) AND NOT contains({_q(v.upper())}, upper(declared)) THEN {_q(v)} END" for v, marks in L.VERSION_MARKERS
) + ")"
_FAMILIES = "list_distinct(" + _list([(f"contains(plain, {_q(p)})", _q(n)) for p, n in R.CHIMERA_SIGNATURES]) + ")"
_SUSPICIOUS = [
    (f"strlen(text) < 100 AND NOT contains({_low}, 'unlicense') AND NOT contains({_low}, 'wtfpl')", "short", 0.20),
    (f"contains({_low}, 'all rights reserved') AND (contains({_low}, 'permission is hereby granted') OR contains({_low}, 'redistribution') OR contains({_low}, 'free software') OR contains({_low}, 'open source'))", "reserved", 0.10),
    (f"contains({_low}, 'copyright (c) [year]') OR contains({_low}, 'copyright (c) <year>')", "template", 0.10),
    (f"(contains({_low}, 'see license') OR contains({_low}, 'see the license')) AND strlen(text) < 500", "pointer", 0.0),
]


def _kind_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({_q(chars)}, {c}) THEN {_q(kind)}" for kind, chars in forensics.KINDS.items()) + " END"


@query(
    f"""WITH {_TEXTS}, c AS (SELECT ord, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM texts WHERE {_ODD_SQL} > 0)
    SELECT ord, CAST(strlen(left(text, i - 1)) AS INTEGER) AS position, {_kind_sql('c')} AS kind, printf('U+%04X', unicode(c)) AS "character" FROM c WHERE contains({_q(forensics.ODD)}, c)"""
)
def licence_unicode_anomalies(spark, sf_dir):
    return forensics.unicode_anomalies(_texts(spark, sf_dir))


@query(f"WITH {_TEXTS}, {_MISSING} SELECT ord, clause, obligation, CAST(penalty AS DOUBLE) AS penalty FROM missing")
def licence_missing_clauses(spark, sf_dir):
    found = F.explode(forensics.missing_clauses(F.col("text"), F.col("declared")))
    return _texts(spark, sf_dir).select("ord", found.alias("m")).select("ord", "m.*")


@query(f"WITH {_TEXTS} SELECT ord, s AS section FROM texts JOIN ({_values([(s,) for s in L.EXTRA_SECTIONS])}) v(s) ON contains({_low}, s)")
def licence_extra_sections(spark, sf_dir):
    return _texts(spark, sf_dir).select("ord", F.explode(forensics.extra_sections(F.col("text"))).alias("section"))


@query(
    f"WITH {_TEXTS} SELECT ord, pattern, kind, CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line FROM (SELECT ord, pattern, kind, left({_low}, instr({_low}, pattern) - 1) AS before FROM texts JOIN ({_values(L.RESTRICTIONS)}) v(pattern, kind) ON contains({_low}, pattern))"
)
def licence_restrictions(spark, sf_dir):
    return _texts(spark, sf_dir).select("ord", F.explode(forensics.custom_restrictions(F.col("text"))).alias("a")).select("ord", "a.*")


@query(f"WITH {_TEXTS} SELECT ord, declared, confused_with FROM (SELECT ord, declared, {_CONFUSED} AS confused_with FROM texts) WHERE confused_with IS NOT NULL")
def licence_version_confusion(spark, sf_dir):
    return _texts(spark, sf_dir).select("ord", "declared", forensics.version_confusion(F.col("text"), F.col("declared")).alias("confused_with")).filter("confused_with IS NOT NULL")


@query(f"WITH {_TEXTS} SELECT ord, phrase FROM texts JOIN ({_values([(s,) for s in L.TRANSLATED])}) v(phrase) ON contains({_low}, phrase)")
def licence_translation_artifacts(spark, sf_dir):
    return _texts(spark, sf_dir).select("ord", F.explode(forensics.translation_artifacts(F.col("text"))).alias("phrase"))


@query(f"WITH {_TEXTS} " + " UNION ALL ".join(f"SELECT ord, {_q(n)} AS pattern FROM texts WHERE {w}" for w, n, _ in _SUSPICIOUS))
def licence_suspicious_patterns(spark, sf_dir):
    return _texts(spark, sf_dir).select("ord", F.explode(forensics.suspicious_patterns(F.col("text"))).alias("s")).select("ord", "s.pattern")


@query(
    f"""WITH {_TEXTS}, {_MISSING},
    p AS (SELECT *, {_plain_sql('text')} AS plain FROM texts),
    f AS (SELECT *, {_FAMILIES} AS families FROM p),
    a AS (SELECT ord, declared, {_licence_sql('plain')} AS detected, {_ODD_SQL} AS anomalies, len(families) >= 3 AS chimera, {_CONFUSED} AS confused_with,
      len({_list([(f"contains({_low}, {_q(p)})", "1") for p, _ in L.RESTRICTIONS])}) AS additions, len({_list([(f"contains({_low}, {_q(p)})", "1") for p in L.TRANSLATED])}) AS artifacts,
      {" + ".join(f"CASE WHEN {w} THEN {p}::DOUBLE ELSE 0 END" for w, _, p in _SUSPICIOUS)} AS suspicious,
      CASE WHEN len(families) >= 3 THEN 0.4::DOUBLE WHEN len(families) = 2 AND list_contains(families, 'GPL') AND list_has_any(families, ['Apache', 'MIT', 'MIT-style']) THEN 0.15::DOUBLE ELSE 0 END AS mixed FROM f),
    m AS (SELECT ord, sum(CAST(penalty AS DOUBLE)) AS missing FROM missing GROUP BY ord)
    SELECT ord, detected, chimera, CAST(anomalies AS INTEGER) AS anomalies, CAST(additions AS INTEGER) AS additions,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(1 - (0.15::DOUBLE * anomalies + coalesce(missing, 0) + 0.1::DOUBLE * additions + CASE WHEN confused_with IS NULL THEN 0 ELSE 0.3::DOUBLE END + mixed + 0.05::DOUBLE * artifacts + suspicious), 6))) AS trust
    FROM a LEFT JOIN m USING (ord)"""
)
def licence_trust(spark, sf_dir):
    return forensics.analyse(_texts(spark, sf_dir), F.col("declared")).select("ord", "detected", "chimera", "anomalies", F.size("additions").alias("additions"), "trust")


# ---------------------------------------------------------------- the licence table

_TABLE = "known(id, name, family, osi, fsf, proprietary) AS (" + _values([(r[0], r[1], r[2], r[4], r[5], r[6]) for r in L.LICENCES]) + ")"
_DUTIES = "duties(id, place, obligation) AS (" + _values([(r[0], k, o) for r in L.LICENCES for k, o in enumerate(r[3])]) + ")"
_OF_TEXT = f"l AS (SELECT doc_id AS ord, {_licence_sql('plain')} AS licence FROM (SELECT doc_id, {_plain_sql('text')} AS plain FROM documents))"


def _licensed(spark, sf_dir):
    return _files(spark, sf_dir).select("ord", F.col("path").alias("name"), licence_of_text(F.col("text")).alias("licence")).filter("licence IS NOT NULL")


@query(f"WITH {_TABLE}, {_OF_TEXT} SELECT ord, licence, k.name, k.family, k.osi AS osi_approved FROM l LEFT JOIN known k ON upper(k.id) = upper(l.licence) WHERE licence IS NOT NULL")
def licence_lookup(spark, sf_dir):
    return licences.lookup(_licensed(spark, sf_dir).drop("name")).select("ord", "licence", "known.name", "known.family", "known.osi_approved")


@query(f"WITH {_DUTIES}, {_OF_TEXT} SELECT ord, licence, obligation FROM l JOIN duties d ON upper(d.id) = upper(l.licence)")
def licence_obligations(spark, sf_dir):
    return licences.obligations(_licensed(spark, sf_dir)).select("ord", "licence", F.explode("obligations").alias("obligation"))


_PART_LICENCES = [(r[0],) for r in L.LICENCES] + [("mit",), ("Unheard-1.0",), (None,)]


@query(f"WITH {_TABLE} SELECT family, count(*) AS licences, count_if(osi) AS approved FROM {dealt_sql(_PART_LICENCES, 'licence')} JOIN known ON upper(known.id) = upper(licence) GROUP BY family")
def licences_by_family(spark, sf_dir):
    """Families of the licences that parts declare."""
    known = licences.lookup(dealt(spark, sf_dir, _PART_LICENCES, "licence")).filter("known IS NOT NULL").select("known.*")
    return known.groupBy("family").agg(F.count("*").alias("licences"), F.count_if("osi_approved").alias("approved"))


_HEADERS = "heads(id, n, phrase) AS (" + _values([(r[0], len(r[9]), p.lower()) for r in L.LICENCES for p in r[9]]) + ")"


@query(f"WITH {_TEXTS}, {_HEADERS} SELECT ord, id, CAST(count(*) AS INTEGER) AS matched, round(count(*) / any_value(n)::DOUBLE, 6) AS confidence FROM texts JOIN heads ON contains({_low}, phrase) GROUP BY ord, id HAVING count(*) >= least(2, any_value(n))")
def licence_header_matches(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("ord", F.explode(licences.header_matches(F.col("text"))).alias("h"))
    return rows.select("ord", "h.id", "h.matched", F.round("h.confidence", 6).alias("confidence"))


_SPELLINGS = [("mit",), ("GPLv3",), ("gplv2",), (" Apache-2.0 ",), ("AGPLv3",), ("nope",), ("ISC",), (None,)]


@query("WITH s(id, spelling) AS (" + _values([(r[0], s.upper()) for r in L.LICENCES for s in r[7]]) + f") SELECT part, declared, min(s.id) AS licence FROM {dealt_sql(_SPELLINGS, 'declared')} LEFT JOIN s ON s.spelling = upper(trim(declared)) GROUP BY part, declared")
def licence_spellings(spark, sf_dir):
    return dealt(spark, sf_dir, _SPELLINGS, "declared").select("part", "declared", licences.spelled(F.col("declared")).alias("licence"))


# ---------------------------------------------------------------- policy

_POLICY = licences.LicencePolicy(allowed=["MIT", "ISC", "BSD-3-Clause"], blocked=["GPL-3.0-only", "GPL-2.0-only", "SSPL-1.0"], ignored=["documents/1.txt"])


@query(
    f"WITH {_OF_TEXT}, d AS (SELECT 'documents/' || ord || '.txt' AS name, licence FROM l WHERE licence IS NOT NULL AND ord <> 1) SELECT name, licence, 'blocked' AS rule, 'Critical' AS severity FROM d WHERE upper(licence) IN ('GPL-3.0-ONLY', 'GPL-2.0-ONLY', 'SSPL-1.0') UNION ALL SELECT name, licence, 'unapproved', 'High' FROM d WHERE upper(licence) NOT IN ('MIT', 'ISC', 'BSD-3-CLAUSE')"
)
def policy_licences(spark, sf_dir):
    return licences.policy_findings(_licensed(spark, sf_dir), _POLICY)


_SEVERITIES = [(n,) for n in ("Critical", "HIGH", "med", "medium", "low", "?")]


@query("SELECT part, name, CASE lower(name) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'med' THEN 2 ELSE 1 END AS rank FROM " + dealt_sql(_SEVERITIES, "name"))
def policy_severities(spark, sf_dir):
    return dealt(spark, sf_dir, _SEVERITIES, "name").select("part", "name", licences.severity_rank(F.col("name")).alias("rank"))


@query(
    f"""WITH {_OF_TEXT}, f AS (SELECT ord, licence, {_family_sql('licence')} AS up FROM l WHERE licence IS NOT NULL)
    SELECT 'documents/' || ord || '.txt' AS name, licence, 'Proprietary' AS project, 'Critical' AS severity FROM f WHERE up NOT IN ('PublicDomain', 'Permissive', 'PermissivePatent') AND (up IN ('StrongCopyleft', 'Proprietary', 'NetworkCopyleft', 'CreativeCommonsRestricted') OR (up = 'WeakCopyleft' AND contains(upper(licence), 'LGPL')))"""
)
def incompatible_dependencies(spark, sf_dir):
    return licences.incompatible_dependencies(_licensed(spark, sf_dir), "Proprietary", True, True, True)
