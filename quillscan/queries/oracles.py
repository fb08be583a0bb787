"""SQL for queries of the catalog that were registered without one."""

from __future__ import annotations

from ..catalog import _DEPS_SQL, _DETECTED, _HEADERS, _IDS, ORACLE_SQL, _family_sql, _q, _values, dealt_sql
from ..operators import findings

_LEVEL = "CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' ELSE 'note' END"
_WEIGHTS = f"w(vtype, multiplier) AS ({_values(findings.multiplier_rows(findings.Policy()))})"

ORACLE_SQL["risk_score"] = f"""WITH {_DETECTED}, {_WEIGHTS}, s AS (SELECT CAST(least(100, coalesce(sum(CAST(trunc([1, 5, 15, 30][sev_rank] * coalesce(multiplier, 1.0)::DOUBLE * confidence) AS INTEGER)), 0)) AS INTEGER) AS score FROM dedup LEFT JOIN w USING (vtype))
SELECT score, CASE WHEN score = 0 THEN 'Clean' WHEN score <= 20 THEN 'Low' WHEN score <= 50 THEN 'Medium' WHEN score <= 80 THEN 'High' ELSE 'Critical' END AS level FROM s"""

ORACLE_SQL["sarif_results"] = f"WITH {_DETECTED} SELECT ord, vtype AS rule, {_LEVEL} AS level, CAST(json_object('ruleId', vtype, 'level', {_LEVEL}, 'message', json_object('text', evidence), 'location', json_object('uri', file)) AS VARCHAR) AS result FROM dedup"

ORACLE_SQL["evidence_chains"] = f"""WITH {_DETECTED}, i AS (SELECT file, ord, sha256(vtype || '|' || file || '|' || coalesce(evidence, '')) AS h FROM dedup)
SELECT file, CAST(count(*) AS INTEGER) AS items, sha256('scan|' || string_agg(h, '|' ORDER BY ord) || '|1970-01-01T00:00:00Z') AS chain_hash FROM i GROUP BY file"""


def _compatibility(commercial: bool, network: bool, static: bool) -> str:
    arms = [
        ("up = 'PublicDomain' OR down = 'PublicDomain'", "Compatible"),
        ("up IN ('Permissive', 'PermissivePatent')", "Conditional"),
        ("up = 'StrongCopyleft' AND down = 'StrongCopyleft' AND contains(u, 'GPL-2') AND contains(d, 'GPL-3')", "Incompatible"),
        ("up = 'StrongCopyleft' AND down = 'StrongCopyleft'", "Compatible"),
        ("up = 'StrongCopyleft' AND down = 'PermissivePatent' AND contains(u, 'GPL-2')", "Incompatible"),
        ("up = 'StrongCopyleft' AND down IN ('PermissivePatent', 'Permissive')", "Compatible"),
        ("up = 'StrongCopyleft' AND down = 'Proprietary'", "Incompatible"),
        (f"up = 'NetworkCopyleft' AND {network}", "Incompatible"),
        (f"up = 'WeakCopyleft' AND {static} AND contains(u, 'LGPL')", "Incompatible"),
        (f"up = 'CreativeCommonsRestricted' AND {commercial}", "Incompatible"),
        ("up = 'Proprietary'", "Incompatible"),
    ]
    return "CASE " + " ".join(f"WHEN {w} THEN {_q(r)}" for w, r in arms) + " ELSE 'Conditional' END"


ORACLE_SQL["license_compatibility_matrix"] = f"""WITH v AS (SELECT * FROM {dealt_sql([(a, b) for a in _IDS if a for b in _IDS if b], 'upstream', 'downstream')}),
p AS (SELECT part, upstream, downstream, {_family_sql('upstream')} AS up, {_family_sql('downstream')} AS down, upper(upstream) AS u, upper(downstream) AS d FROM v)
SELECT part, upstream, downstream, {_compatibility(False, False, False)} AS plain, {_compatibility(True, True, True)} AS strict FROM p"""

_D = f"d AS (SELECT *, row_number() OVER (ORDER BY ecosystem, name) AS n FROM (SELECT ecosystem, name || '-' || part AS name, version_spec FROM {_DEPS_SQL}))"
ORACLE_SQL["spdx_packages"] = f"WITH {_D} SELECT CAST(n AS INTEGER) AS number, CAST(json_object('SPDXID', 'SPDXRef-Package-' || n, 'name', name, 'versionInfo', coalesce(version_spec, 'NOASSERTION')) AS VARCHAR) AS package FROM d"
_PURL = "'pkg:' || CASE ecosystem WHEN 'crates' THEN 'cargo' WHEN 'go' THEN 'golang' ELSE ecosystem END || '/' || CASE WHEN ecosystem = 'npm' AND starts_with(name, '@') THEN '%40' || name[2:] ELSE name END || coalesce('@' || version_spec, '')"
ORACLE_SQL["cyclonedx_components"] = f"WITH {_D} SELECT name, CAST(CASE WHEN version_spec IS NULL THEN json_object('type', 'library', 'name', name, 'purl', {_PURL}) ELSE json_object('type', 'library', 'name', name, 'version', version_spec, 'purl', {_PURL}) END AS VARCHAR) AS component FROM d"

ORACLE_SQL["package_specs"] = f"SELECT part, spec, ecosystem, name, version FROM {dealt_sql([('npm:react@18.2.0', 'npm', 'react', '18.2.0'), ('npm:@types/node@20', 'npm', '@types/node', '20'), ('npm:@types/node', 'npm', '@types/node', None), ('pip:numpy', 'pypi', 'numpy', None), ('crate:serde@1', 'crates', 'serde', '1'), ('crx:abc', 'crx', 'abc', None)], 'spec', 'ecosystem', 'name', 'version')}"
ORACLE_SQL["file_categories"] = f"SELECT part, path, category FROM {dealt_sql([('LICENSE', 'License'), ('src/a.rs', 'SourceCode'), ('package.json', 'Manifest'), ('x/b.JS', 'JavaScript'), ('data.csv', 'Data'), ('img.png', 'Image'), ('f.woff2', 'Font'), ('README', 'Other'), ('a.md', 'Document')], 'path', 'category')}"
ORACLE_SQL["input_kinds"] = f"SELECT part, target, kind FROM {dealt_sql([('./src', 'LocalPath'), ('npm:react@18', 'Package'), ('https://github.com/a/b', 'GitRepo'), ('https://example.com', 'WebsiteUrl'), ('https://example.com/a.js', 'FileUrl'), ('docker:nginx', 'DockerImage'), ('a.apk', 'MobileApp'), ('b.wasm', 'WasmBinary'), ('-', 'Stdin'), ('git@github.com:a/b.git', 'GitRepo'), ('c.zip', 'Archive'), ('d.asar', 'ElectronApp'), ('crx:abc', 'BrowserExtension')], 'target', 'kind')}"
ORACLE_SQL["manifest_dependencies"] = """WITH k AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part) SELECT k || '/package.json' AS path, 'npm' AS ecosystem, 'react-' || k AS name, '18.2.' || k AS version_spec FROM k UNION ALL SELECT k || '/package.json', 'npm', 'jest', '^' || k FROM k
UNION ALL SELECT k || '/requirements.txt', 'pypi', 'numpy', '1.' || k FROM k UNION ALL SELECT k || '/requirements.txt', 'pypi', 'flask-' || k, '2.' || k FROM k UNION ALL SELECT k || '/requirements.txt', 'pypi', 'six', NULL FROM k"""
ORACLE_SQL["pii_columns"] = f"""SELECT part, path, "column", CASE "column" WHEN 'email' THEN 'Email' WHEN 'phone' THEN 'PhoneNumber' END AS kind FROM (SELECT part, path, unnest(string_split(string_split(text, chr(10))[1], ',')) AS "column" FROM {dealt_sql(_HEADERS, 'path', 'text')})"""
ORACLE_SQL["text_entropy"] = """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents WHERE text <> ''), c AS (SELECT doc_id, count(*) AS n FROM b GROUP BY doc_id, b), t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(e, 0.0::DOUBLE), 6) AS entropy FROM documents LEFT JOIN (SELECT c.doc_id, -sum(n / t::DOUBLE * log2(n / t::DOUBLE)) AS e FROM c JOIN t USING (doc_id) GROUP BY c.doc_id) USING (doc_id)"""
