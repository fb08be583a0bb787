"""Attribution of projects: an order is a project, its lines are vendored dependencies, with and without licences, notices and headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import _family_sql, _q, query
from ..operators import attribution as A
from ..refdata_licences import LICENCES
from .classification import classify_sql

_LICENCES = ["MIT", "Apache-2.0", "GPL-3.0-only", "BSD-2-Clause", "Unheard-1.0"]
_TEXTS = ["MIT License. Permission is hereby granted", "Apache License, version of January", "GNU General Public License, either version 3", "nothing to see", "SPDX-License-Identifier: ISC"]


def _pick(values: list[str], by: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in enumerate(values))
    return f"CASE {by} % {len(values)} {cases} END"


_NAME = "CASE WHEN l_partkey % 6 = 0 THEN '@scope/' ELSE '' END || 'pkg-' || CAST(l_partkey AS STRING)"
_FOLDER = f"{_pick(['vendor', 'node_modules', 'third_party', 'elsewhere'], 'l_partkey')} || '/' || {_NAME}"
_L, _O = "FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL", "FROM orders WHERE o_orderkey IS NOT NULL"
#: Tables in SQL that Spark and DuckDB share.
PROJECTS = f"SELECT o_orderkey AS project, {_pick(_LICENCES, 'o_orderkey')} AS licence {_O}"
DEPENDENCIES = f"SELECT l_orderkey AS project, {_NAME} AS name, {_pick(_LICENCES, '(l_partkey + l_suppkey)')} AS licence {_L}"
FILES = " UNION ALL ".join(
    [
        f"SELECT o_orderkey AS project, 'LICENSE' AS path, {_pick(_TEXTS, 'o_custkey')} AS text {_O} AND o_orderkey % 4 <> 0",
        f"SELECT o_orderkey, 'COPYING', {_pick(_TEXTS, '(o_custkey + 1)')} {_O} AND o_orderkey % 8 = 1",
        f"SELECT o_orderkey, 'NOTICES', 'uses PKG-' || CAST(o_custkey AS STRING) || ' and @Scope/pkg-1, pkg-12, pkg-3, pkg-7' {_O} AND o_orderkey % 3 = 0",
        f"SELECT o_orderkey, 'dist/js/app.js', CASE WHEN o_orderkey % 2 = 0 THEN '/*! @license MIT */' ELSE '/* app */' END || repeat('v', CAST(9900 + o_custkey % 200 AS INT)) {_O} AND o_orderkey % 5 = 0",
        f"SELECT o_orderkey, 'build/a/b/c/d/e.css', repeat('w', 10001) {_O} AND o_orderkey % 10 = 0",
        f"SELECT l_orderkey, {_FOLDER} || '/' || CASE WHEN l_partkey % 2 = 0 THEN 'LICENSE.md' ELSE 'LICENCE' END, {_pick(_TEXTS, 'l_suppkey')} {_L} AND l_partkey % 3 <> 0",
        f"SELECT l_orderkey, {_FOLDER} || '/src/main.' || CASE WHEN l_partkey % 2 = 0 THEN 'py' ELSE 'txt' END, CASE WHEN l_suppkey % 2 = 0 THEN '# Copyright someone' ELSE 'x = 1' END {_L}",
        f"SELECT l_orderkey, {_FOLDER} || '/a/b/c/d/deep.js', 'y' {_L} AND l_partkey % 5 = 0",
        f"SELECT l_orderkey, {_FOLDER} || '/a/b/c/d/e/deeper.js', '// license' {_L} AND l_partkey % 5 = 0",
        f"SELECT l_orderkey, 'lib/' || {_NAME} || '/x.md', 'z' {_L} AND l_partkey % 7 = 0",
    ]
)


def tables(spark, sf_dir):
    """Projects, files and dependencies."""
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"_attribution_{name}")
    of = lambda sql: spark.sql(sql.replace("FROM orders", "FROM _attribution_orders").replace("FROM lineitem", "FROM _attribution_lineitem"))
    return of(PROJECTS), of(FILES), of(DEPENDENCIES)


_place = lambda name, names: f"list_position([{', '.join(map(_q, names))}], {name})"
_OWES = lambda o: ", ".join(_q(r[0].upper()) for r in LICENCES if o in r[3])
_SQL = f"""WITH projects AS ({PROJECTS}), deps AS (SELECT project, name, min(licence) AS licence FROM ({DEPENDENCIES}) GROUP BY project, name),
files AS MATERIALIZED (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS fname FROM ({FILES})), texts AS (SELECT text FROM files WHERE {_place('fname', A.LICENCE_FILES)} IS NOT NULL AND {_place('fname', A.LICENCE_FILES)} > 0),
{classify_sql('texts')}, said AS (SELECT text, licence, confidence, {_family_sql('licence')} AS fam FROM candidate WHERE rank = 1),
lic AS MATERIALIZED (SELECT f.*, {_place('fname', A.LICENCE_FILES)} AS place, s.licence AS said, s.confidence, s.fam FROM files f LEFT JOIN said s USING (text) WHERE {_place('fname', A.LICENCE_FILES)} > 0),
root AS (SELECT p.project, p.licence, {_family_sql('p.licence')} AS own, l.place, l.said, l.confidence, l.fam FROM projects p LEFT JOIN (SELECT * FROM lic WHERE len(parts) = 1 QUALIFY row_number() OVER (PARTITION BY project ORDER BY place) = 1) l USING (project)),
notice AS (SELECT project, lower(text) AS notice FROM files WHERE {_place('path', A.NOTICE_FILES)} > 0),
tops(top, rank) AS (VALUES {', '.join(f'({_q(f)}, {k})' for k, f in enumerate(A.VENDOR_FOLDERS))}),
under AS MATERIALIZED (SELECT d.project, d.name, rank, top || '/' || d.name AS folder, f.path, f.text, f.fname, len(f.parts) - len(string_split(d.name, '/')) - 1 AS below FROM deps d JOIN files f USING (project) JOIN tops ON f.parts[1] = top WHERE starts_with(f.path, top || '/' || d.name || '/')),
first_ AS (SELECT * FROM under QUALIFY rank = min(rank) OVER (PARTITION BY project, name)),
sourced AS (SELECT *, regexp_extract(fname, '\\.([^.]+)$', 1) IN ({', '.join(map(_q, A.SOURCES))}) AND below <= {A.VENDOR_DEPTH} AS source, regexp_matches(lower(text), '{'|'.join(A.HEADER_WORDS)}') AS headed FROM first_),
vend AS (SELECT project, name, any_value(folder) AS folder, count_if(source) AS sources, count_if(source AND headed) AS headed FROM sourced GROUP BY project, name),
vlic AS (SELECT u.project, u.name, l.said, l.confidence, l.fam FROM first_ u JOIN lic l ON u.project = l.project AND u.path = l.path AND u.text = l.text WHERE below = 1 QUALIFY row_number() OVER (PARTITION BY u.project, u.name ORDER BY l.place, l.said IS NOT NULL, l.said) = 1),
status AS MATERIALIZED (SELECT d.project, d.name, d.licence, v.folder, l.name IS NOT NULL AS has_licence, l.said, l.confidence, CASE WHEN l.said IS NOT NULL THEN l.said = d.licence OR l.fam = {_family_sql('d.licence')} END AS matches,
  CASE WHEN upper(d.licence) IN ({_OWES('NoticeFile')}) THEN coalesce(contains(n.notice, lower(d.name)), false) END AS in_notice, n.notice IS NOT NULL AS has_notice,
  CASE WHEN v.folder IS NOT NULL AND upper(d.licence) IN ({_OWES('HeaderPreservation')}) THEN v.sources = 0 OR v.headed / v.sources >= {A.HEADER_SHARE} END AS headers_kept, upper(d.licence) IN ({_OWES('Attribution')}) AS owes
  FROM deps d LEFT JOIN vend v USING (project, name) LEFT JOIN vlic l USING (project, name) LEFT JOIN notice n USING (project)),
built AS (SELECT project, path, strlen(text) AS size, strlen(text) >= {A.BUILT_BYTES} AND NOT regexp_matches(text, {_q(A.COMMENT)}) AS bare FROM files WHERE parts[1] IN ({', '.join(map(_q, A.BUILD_FOLDERS))}) AND len(parts) <= {A.BUILD_DEPTH + 1} AND regexp_extract(fname, '\\.([^.]+)$', 1) IN ({', '.join(map(_q, A.BUILT))}))
"""


@query(_SQL + "SELECT project, name, licence, folder, has_licence, matches, in_notice, headers_kept FROM status")
def dependency_attribution(spark, sf_dir):
    """What each dependency of each project keeps."""
    return A.check(*tables(spark, sf_dir)).dependencies


@query(
    _SQL
    + f"""SELECT project, 'MissingAttribution' AS vtype, 'Medium' AS severity, 0.99::DOUBLE AS confidence, '.' AS subject, licence AS evidence FROM root WHERE place IS NULL
  UNION ALL SELECT project, 'IncorrectAttribution', 'Critical', round(confidence, 6), '.', said FROM root WHERE said IS NOT NULL AND said <> licence AND fam <> own AND confidence > {A.SURE}
  UNION ALL SELECT project, 'MissingNoticeFile', 'Medium', 0.95, '.', CAST(count(*) AS VARCHAR) FROM status WHERE in_notice IS NOT NULL AND NOT has_notice GROUP BY project
  UNION ALL SELECT project, 'MissingNoticeFile', 'Low', 0.8, name, licence FROM status WHERE NOT in_notice AND has_notice
  UNION ALL SELECT project, 'IncorrectAttribution', 'High', round(confidence, 6), name, said FROM status WHERE NOT matches AND confidence > {A.SURE}
  UNION ALL SELECT project, 'StrippedLicense', 'High', 0.9, name, folder FROM status WHERE folder IS NOT NULL AND NOT has_licence AND owes
  UNION ALL SELECT project, 'StrippedLicense', 'Medium', 0.8, name, folder FROM status WHERE NOT headers_kept
  UNION ALL SELECT project, 'MissingAttribution', 'Low', 0.65, path, CAST(size AS VARCHAR) FROM built WHERE bare"""
)
def attribution_findings(spark, sf_dir):
    """Licences, notices and headers that projects lack."""
    return A.check(*tables(spark, sf_dir)).findings.withColumn("confidence", F.round("confidence", 6))


@query(
    _SQL
    + f""", pts AS (SELECT project, count(*) AS n, avg((has_licence::INT + coalesce(matches, false)::INT + coalesce(in_notice, false)::INT + coalesce(headers_kept, false)::INT) / (1 + (matches IS NOT NULL)::INT + (in_notice IS NOT NULL)::INT + (headers_kept IS NOT NULL)::INT)::DOUBLE) AS mean FROM status GROUP BY project),
  b AS (SELECT project, count(*) AS files, count_if(bare) AS bare FROM built GROUP BY project)
  SELECT project, coalesce(n, 0) AS n_dependencies, coalesce(files, 0) AS built_files, coalesce(bare, 0) AS built_bare, round(coalesce(CASE WHEN files > 0 THEN {A.DEPENDENCY_WEIGHT}::DOUBLE * mean + {1 - A.DEPENDENCY_WEIGHT:.1f}::DOUBLE * (1 - bare / files::DOUBLE) ELSE mean END, 1), 6) AS completeness FROM projects LEFT JOIN pts USING (project) LEFT JOIN b USING (project)"""
)
def attribution_scores(spark, sf_dir):
    """How complete each project's attribution is."""
    return A.check(*tables(spark, sf_dir)).scores.withColumn("completeness", F.round("completeness", 6))
