"""Queries over lock files, manifests and supply-chain checks, on literal files and on names made from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..catalog import _q, _values, dealt, dealt_sql, query
from ..operators import manifests as M
from ..operators.supply_chain import popular_packages
from ..storage import spread

#: A project's files of every format.
_FILES = [
    ("a/package-lock.json", '{"name": "app", "lockfileVersion": 2, "packages": {"": {"version": "1.0.0"}, "node_modules/left": {"version": "1.2.3", "license": "MIT", "dependencies": {"right": "^1.0.0"}}, "node_modules/left/node_modules/right": {"version": "2.0.0", "dev": true}}}'),
    ("b/package-lock.json", '{"name": "old", "lockfileVersion": 1, "dependencies": {"one": {"version": "1.0.0", "requires": {"two": "2"}, "dependencies": {"two": {"version": "2.1.0", "dependencies": {"three": {"version": "3.0.0"}}}}}}}'),
    ("a/package.json", '{"name": "app", "dependencies": {"left": "^1.0.0", "@evil/react": "1.0.0"}, "devDependencies": {"left": "2", "jest": "29.0.0"}}'),
    ("c/metadata.json", '{"packages": [{"id": "x 1.0", "name": "x", "version": "1.0.0", "license": "MIT/Apache-2.0", "targets": [{"kind": ["lib"]}]}, {"id": "y 2.0", "name": "y", "version": "2.0.0", "license": "GPL-2.0-only WITH Classpath-exception-2.0", "targets": [{"kind": ["proc-macro"]}]}], "resolve": {"nodes": [{"id": "x 1.0", "deps": [{"name": "y"}]}, {"id": "y 2.0", "deps": []}]}}'),
    ("c/Cargo.lock", 'version = 3\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\ndependencies = [\n "serde_derive 1.0.1",\n "itoa",\n]\n\n[[package]]\nname = "itoa"\nversion = "1.0.9"\n'),
    ("d/go.sum", "example.com/a v1.0.0 h1:x=\nexample.com/a v1.0.0/go.mod h1:y=\nexample.com/b v0.2.0/go.mod h1:z=\n"),
    ("d/go.mod", "module example.com/m\n\nrequire (\n\texample.com/a v1.0.0\n\texample.com/b v0.2.0 // indirect\n)\n\nrequire example.com/c v3.0.0\n"),
    ("e/requirements.txt", "# all\nrequests==2.31.0\nflask >= 2.0\n-r more.txt\nnumpy\n"),
    ("f/pom.xml", "<project><dependencies><dependency><groupId>org.a</groupId><artifactId>b</artifactId><version>1.0</version><scope>test</scope></dependency>\n<dependency>\n<groupId>org.c</groupId>\n<artifactId>d</artifactId></dependency></dependencies></project>"),
    ("f/build.gradle", "dependencies {\n  implementation 'com.a:b:1.0'\n  testImplementation(\"com.c:d:2.0\")\n  compileOnly 'com.e:f'\n}\n"),
    ("g/app.csproj", '<ItemGroup><PackageReference Include="Json" Version="13.0.1" /><PackageReference Include="Log" /></ItemGroup>'),
    ("g/packages.config", '<packages><package id="Json" version="12.0.0" /><package id="Old" version="1.1.0" targetFramework="net45" /></packages>'),
    ("h/composer.lock", '{"packages": [{"name": "v/a", "version": "1.0", "license": ["MIT", "GPL-2.0"], "require": {"php": ">=8", "ext-json": "*", "v/b": "1"}}], "packages-dev": [{"name": "v/t", "version": "9.0", "license": ["BSD-3-Clause"]}]}'),
    ("h/composer.json", '{"name": "v/app", "require": {"php": ">=8", "ext-json": "*", "v/a": "^1.0"}}'),
    ("i/Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n    rack (2.2.3)\n    rails (7.0.4)\n      rack (>= 2.2)\n      thor (~> 1.0)\n\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n  rails\n"),
]
#: Every part is a project with these files.
_SQL_FILES = f"files AS (SELECT CAST(p_partkey AS VARCHAR) || '/' || path AS path, text FROM part, ({_values(_FILES)}) v(path, text))"


def _files(spark, sf_dir):
    fixed = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in _FILES))
    each = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey IS NOT NULL").select("p_partkey", F.explode(fixed).alias("f"))
    return each.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/"), "f.path").alias("path"), "f.text")


def _named(spark, sf_dir, name):
    return _files(spark, sf_dir).filter(F.col("path").endswith("/" + name))


def _flat(nodes):
    """Lists as text, so that any engine compares them."""
    return nodes.select("path", "ecosystem", "name", "version", "licence", "expression", F.array_join("depends_on", ",").alias("depends_on"), "linking", F.array_join("exceptions", ",").alias("exceptions"), "build_only")


def _node_sql(rows: str, ecosystem: str, name: str, version: str, linking: str, licence: str = "'UNKNOWN'", expression: str = "CAST(NULL AS VARCHAR)", deps: str = "''", exceptions: str = "''", build: str = "false") -> str:
    return f"SELECT path, {_q(ecosystem)} AS ecosystem, {name} AS name, {version} AS version, {licence} AS licence, {expression} AS expression, {deps} AS depends_on, {linking} AS linking, {exceptions} AS exceptions, {build} AS build_only FROM {rows}"


_part = lambda tag: f"regexp_extract(b, '<{tag}>([^<]*)', 1)"
_attribute = lambda name: f"""regexp_extract(b, '{name}="([^"]*)', 1)"""
_RAW = "coalesce(p->>'license', 'UNKNOWN')"
_NPM = "(SELECT path, unnest(json_keys(j)) AS key, j FROM (SELECT path, text->'packages' AS j FROM files WHERE ends_with(path, '/a/package-lock.json')))"
_LINES = "(SELECT path, i, trim(l) AS l FROM (SELECT path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM files))"
_NODES = [
    _node_sql(f"(SELECT path, key, json_extract(j, '$.\"' || key || '\"') AS p FROM {_NPM} WHERE key <> '')", "npm", "regexp_replace(key, '^node_modules/', '')", "p->>'version'", "'Source'", _RAW, _RAW, "coalesce(array_to_string(json_keys(p->'dependencies'), ','), '')", "''", "coalesce(CAST(p->>'dev' AS BOOLEAN), false)"),
    _node_sql("(SELECT path, unnest(CAST(text->'packages' AS JSON[])) AS p, text->'resolve'->'nodes' AS nodes FROM files WHERE ends_with(path, '/c/metadata.json'))", "crates", "p->>'name'", "p->>'version'", "CASE WHEN contains(CAST(p->'targets' AS VARCHAR), 'proc-macro') THEN 'ProcMacro' ELSE 'Static' END", f"string_split({_RAW}, ' OR ')[1]", f"replace({_RAW}, '/', ' OR ')",
        "(SELECT coalesce(array_to_string(list_transform(CAST(n->'deps' AS JSON[]), lambda d: d->>'name'), ','), '') FROM (SELECT unnest(CAST(nodes AS JSON[])) AS n) WHERE n->>'id' = p->>'id')", f"CASE WHEN contains({_RAW}, ' WITH ') THEN trim(string_split({_RAW}, ' WITH ')[2]) ELSE '' END"),
    _node_sql("(SELECT path, unnest(string_split(text, '[[package]]')[2:]) AS b FROM files WHERE ends_with(path, '/c/Cargo.lock'))", "crates", "regexp_extract(b, 'name = \"([^\"]*)', 1)", "regexp_extract(b, 'version = \"([^\"]*)', 1)", "'Static'", deps="array_to_string(regexp_extract_all(b, '\"([^\" ]+) [^\"]+\",', 1), ',')"),
    _node_sql(f"(SELECT path, string_split(l, ' ')[1] AS n, arg_min(regexp_replace(string_split(l, ' ')[2], '/go.mod$', ''), i) AS v FROM {_LINES} WHERE ends_with(path, '/d/go.sum') AND contains(l, ' ') GROUP BY ALL)", "go", "n", "v", "'Static'"),
    _node_sql(f"(SELECT path, l FROM {_LINES} WHERE ends_with(path, '/e/requirements.txt') AND l <> '' AND l[1] NOT IN ('#', '-'))", "pypi", "trim(regexp_extract(l, '^([^=>]*)', 1))", "nullif(trim(regexp_extract(l, '[=>]=(.*)$', 1)), '')", "'Source'"),
    _node_sql("(SELECT path, unnest(string_split(text, '<dependency>')[2:]) AS b FROM files WHERE ends_with(path, '/f/pom.xml'))", "maven", f"{_part('groupId')} || ':' || {_part('artifactId')}", f"nullif({_part('version')}, '')", "'Static'", build=f"{_part('scope')} IN ('test', 'provided', 'system')"),
    _node_sql("(SELECT path, trim(l) AS l, regexp_extract_all(l, '[^:''\"() ]+')[2:] AS c FROM (SELECT path, unnest(string_split(text, chr(10))) AS l FROM files WHERE ends_with(path, '/f/build.gradle')) WHERE contains(l, ':'))", "maven", "c[1] || ':' || c[2]", "c[3]", "'Static'", build="starts_with(l, 'test') OR starts_with(l, 'compileOnly')"),
    _node_sql("(SELECT path, unnest(string_split(text, '<PackageReference ')[2:]) AS b FROM files WHERE ends_with(path, '/g/app.csproj'))", "nuget", _attribute("Include"), f"nullif({_attribute('Version')}, '')", "'Static'"),
    _node_sql("(SELECT path, unnest(string_split(text, '<package ')[2:]) AS b FROM files WHERE ends_with(path, '/g/packages.config'))", "nuget", _attribute("id"), _attribute("version"), "'Static'") + f" WHERE {_attribute('id')} NOT IN ('Json', 'Log')",
    _node_sql("(SELECT path, unnest(CAST(text->'packages' AS JSON[])) AS p FROM files WHERE ends_with(path, '/h/composer.lock'))", "composer", "p->>'name'", "p->>'version'", "'Source'", "coalesce(p->'license'->>0, 'UNKNOWN')", "array_to_string(CAST(p->'license' AS VARCHAR[]), ' OR ')", "array_to_string(list_filter(json_keys(p->'require'), lambda k: NOT starts_with(k, 'php') AND NOT starts_with(k, 'ext-')), ',')"),
    _node_sql("(SELECT path, unnest(CAST(text->'packages-dev' AS JSON[])) AS p FROM files WHERE ends_with(path, '/h/composer.lock'))", "composer", "p->>'name'", "p->>'version'", "'Source'", "coalesce(p->'license'->>0, 'UNKNOWN')", build="true"),
    _node_sql(r"(SELECT path, unnest(regexp_extract_all(split_part(split_part(text, 'PLATFORMS', 1), 'specs:' || chr(10), 2), '    [^ \n]+ \([^)]+\)\n(      [^ \n][^\n]*\n)*')) AS b FROM files WHERE ends_with(path, '/i/Gemfile.lock'))", "gems", "regexp_extract(b, '^    ([^ ]+)', 1)", r"regexp_extract(b, '\(([^)]+)\)', 1)", "'Source'", deps=r"array_to_string(regexp_extract_all(b, '      ([^ \n]+)', 1), ',')"),
]


@query(f"WITH {_SQL_FILES} " + " UNION ALL ".join(_NODES))
def lockfile_nodes(spark, sf_dir):
    return _flat(M.dependency_nodes(_files(spark, sf_dir)))


#: Build files of a part, in SQL that Spark and DuckDB share: {k} is its key, {n} its name with dashes, {b} its brand, {v} its version.
_BUILD = {
    "pom.xml": '<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><!-- {b} --><artifactId>own</artifactId><dependencies>\n<dependency><scope>{s}</scope><artifactId>{n}</artifactId>\n<groupId> org.p{k} </groupId><exclusions><exclusion><groupId>no</groupId></exclusion></exclusions></dependency><dependency><groupId>org.b</groupId><artifactId>{n}</artifactId><version>{v}</version></dependency></dependencies></project>',
    "build.gradle": 'dependencies {\n  api("org.p{k}:{n}:{v}")\n  {c} "org.b:{n}"\n  implementation project(":local{k}")\n  api platform("no:no:1")\n}\n',
    "app.csproj": '<Project Sdk="x"><ItemGroup><PackageReference Version="{v}" Include="P{k}.{n}" /><PackageReference Include="B{k}"><Version>{v}</Version></PackageReference><PackageReference Include="L{k}"/></ItemGroup><Broken',
    "packages.config": '<packages><package id="P{k}.{n}" version="1.0" /><package version="{v}" id="Old{k}" targetFramework="net45" /></packages>',
}
_CONFIGURATIONS = ["testImplementation", "runtimeOnly", "compileOnly", "annotationProcessor"]
_SCOPES = ["test", "compile", "system", "runtime"]
_BUILD_ROWS = f"""SELECT p_partkey, CAST(p_partkey AS STRING) AS k, replace(p_name, ' ', '-') AS n, p_brand AS b, CAST(p_size AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) AS v,
  CASE p_partkey % 4 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CONFIGURATIONS))} END AS c, CASE p_partkey % 4 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_SCOPES))} END AS s FROM part WHERE p_partkey IS NOT NULL"""


@query(
    f"""WITH p AS ({_BUILD_ROWS}), node(file, ecosystem, name, version, build_only) AS (
    SELECT k || '/pom.xml', 'maven', 'org.p' || k || ':' || n, NULL, s IN ('test', 'system') FROM p UNION ALL SELECT k || '/pom.xml', 'maven', 'org.b:' || n, v, false FROM p
    UNION ALL SELECT k || '/build.gradle', 'maven', 'org.p' || k || ':' || n, v, false FROM p UNION ALL SELECT k || '/build.gradle', 'maven', 'org.b:' || n, NULL, c <> 'runtimeOnly' FROM p
    UNION ALL SELECT k || '/app.csproj', 'nuget', 'P' || k || '.' || n, v, false FROM p UNION ALL SELECT k || '/app.csproj', 'nuget', 'B' || k, v, false FROM p UNION ALL SELECT k || '/app.csproj', 'nuget', 'L' || k, NULL, false FROM p
    UNION ALL SELECT k || '/packages.config', 'nuget', 'Old' || k, v, false FROM p) SELECT 'part/' || file AS path, ecosystem, name, version, build_only FROM node"""
)
def build_file_dependencies(spark, sf_dir):
    """Dependencies of build files made from parts: any order of parts, name spaces, comments, damaged ends."""
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("_packages_part")
    rows = spread(spark.sql(_BUILD_ROWS.replace("FROM part", "FROM _packages_part")))
    each = rows.select("*", F.explode(F.array(*map(F.lit, _BUILD))).alias("name"))
    body = F.element_at(F.create_map(*(F.lit(x) for item in _BUILD.items() for x in item)), F.col("name"))
    files = each.select(F.concat(F.lit("part/"), "k", F.lit("/"), "name").alias("path"), _filled(body, ["k", "n", "b", "v", "c", "s"]).alias("text"))
    return M.dependency_nodes(files).select("path", "ecosystem", "name", "version", "build_only")


def _filled(body, columns):
    for c in columns:
        body = F.replace(body, F.lit("{" + c + "}"), F.col(c))
    return body


@query(
    f"WITH RECURSIVE {_SQL_FILES}, open(path, key, info, level) AS (SELECT path, unnest(json_keys(text->'dependencies')), text->'dependencies', 1 FROM files WHERE ends_with(path, '/b/package-lock.json') UNION ALL SELECT path, unnest(json_keys(d)), d, level + 1 FROM (SELECT path, json_extract(info, '$.\"' || key || '\".dependencies') AS d, level FROM open) WHERE d IS NOT NULL), "
    "e AS (SELECT path, key AS name, json_extract(info, '$.\"' || key || '\"') AS p, level FROM open) SELECT path, name, coalesce(p->>'version', '0.0.0') AS version, CAST(NULL AS VARCHAR) AS licence, coalesce(array_to_string(json_keys(p->'requires'), ','), '') AS depends_on, level FROM e"
)
def npm_nested_lock_entries(spark, sf_dir):
    return M.npm_lock_entries(_named(spark, sf_dir, "b/package-lock.json")).withColumn("depends_on", F.array_join("depends_on", ","))


@query("SELECT CAST(p_partkey AS VARCHAR) || '/a' AS project, v.* FROM part, (VALUES ('left', '1.2.3', 'MIT', 'right', 1), ('@evil/react', '1.0.0', NULL, '', 1), ('jest', '29.0.0', NULL, '', 1), ('left/node_modules/right', '2.0.0', NULL, '', 2)) v(name, version, licence, depends_on, depth)")
def npm_dependency_tree(spark, sf_dir):
    tree = M.npm_tree(_named(spark, sf_dir, "package.json"), _named(spark, sf_dir, "a/package-lock.json"))
    return tree.withColumn("depends_on", F.array_join("depends_on", ","))


@query(rf"WITH {_SQL_FILES} SELECT path, string_split(l, ' ')[1] AS name, string_split(l, ' ')[2] AS version, CASE WHEN contains(l, '// indirect') THEN 2 ELSE 1 END AS depth FROM (SELECT path, regexp_replace(trim(regexp_replace(l, '\t', '')), '^require ', '') AS l FROM {_LINES} WHERE ends_with(path, '/d/go.mod') AND regexp_matches(l, ' v[0-9]'))")
def go_mod_requirements(spark, sf_dir):
    return M.go_mod(_named(spark, sf_dir, "go.mod"))


@query(f"WITH {_SQL_FILES} SELECT path, k AS name, text->'require'->>k AS version, 1 AS depth FROM (SELECT path, text, unnest(json_keys(text->'require')) AS k FROM files WHERE ends_with(path, '/h/composer.json')) WHERE k <> 'php' AND NOT starts_with(k, 'ext-')")
def composer_requirements(spark, sf_dir):
    return M.composer_manifest(_named(spark, sf_dir, "composer.json"))


def _case(value: str, rows: list[tuple[str, str]], test: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {test.format(v=value, s=_q(s))} THEN {_q(r)} END" for s, r in rows) + ")"


#: Licence spellings dealt to the rows of the part table.
_SPELT = ["MIT", "isc", "GPL-3.0", "agpl-3.0", "BUSL-1.1", "new bsd", "Apache License 2.0", "LGPL-2.1", "weird", "CC0-1.0"]
_PART = f"p AS (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE [{', '.join(map(_q, _SPELT))}][p_partkey % 10 + 1] END AS licence FROM part)"
_SPDX = "coalesce(" + _case("upper(trim(licence))", M.SPDX_SPELLINGS, "{v} = {s}")[9:-1] + ", " + _case("upper(trim(licence))", M.SPDX_PARTS, "contains({v}, {s})")[9:-1] + ")"
_CLASS = "coalesce(" + _case("lower({0})", M.LICENCE_CLASSES, "contains({v}, {s})")[9:-1] + ", 'Unknown')"


def _parts(spark, sf_dir):
    names = F.array(*(F.lit(s) for s in _SPELT))
    licence = F.when(F.col("p_partkey") % 11 != 0, F.element_at(names, (F.col("p_partkey") % 10 + 1).cast("int")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("name"), licence.alias("licence"))


@query(f"WITH {_PART} SELECT p_partkey, {_SPDX} AS spdx, {_CLASS.format('licence')} AS class FROM p")
def licence_spdx_classes(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", M.spdx_of(F.col("licence")).alias("spdx"), M.licence_class(F.col("licence")).alias("class"))


@query(
    f"""WITH {_PART}, c AS (SELECT p_partkey, name, licence, {_SPDX} AS spdx FROM p), k AS (SELECT *, {_CLASS.format('spdx')} AS class FROM c),
    r AS (SELECT licence, 'UnknownLicense' AS reason, 'Warning' AS severity FROM k WHERE licence IS NULL UNION ALL SELECT licence, 'CopyleftInPermissive', 'Critical' FROM k WHERE spdx IS NOT NULL AND class = 'StrongCopyleft'
    UNION ALL SELECT licence, 'AgplContamination', 'Critical' FROM k WHERE class = 'Agpl' UNION ALL SELECT licence, 'SourceAvailableInOpenSource', 'Error' FROM k WHERE class = 'SourceAvailable')
    SELECT reason, severity, count(*) AS dependencies, min(licence) AS licence FROM r GROUP BY ALL"""
)
def tree_conflicts(spark, sf_dir):
    found = M.tree_conflicts(_parts(spark, sf_dir).select("name", "licence"), "MIT")
    return found.groupBy("reason", "severity").agg(F.count("*").alias("dependencies"), F.min("licence").alias("licence"))


_LISTED = [(e, p) for e, names in R.POPULAR.items() for p in names]
_ASKED = [("npm", "body_parser"), ("npm", "lodash-js"), ("npm", "lodash"), ("npm", "@evil/react"), ("npm", "@types/react"), ("npm", "@x/unheard"), ("pypi", "scikit.learn"), ("pypi", "flask-cli"), ("crates", "serdepy-"), ("npm", "expressnode-")]


@query(
    f"""WITH d AS (SELECT DISTINCT ecosystem, name FROM {dealt_sql(_ASKED, 'ecosystem', 'name')}), p(ecosystem, popular) AS ({_values(_LISTED)})
    SELECT ecosystem, name, popular, 'separator' AS flag FROM d JOIN p USING (ecosystem) WHERE translate(name, '-.', '__') = translate(popular, '-.', '__') AND name <> popular
    UNION SELECT ecosystem, name, popular, 'variant' FROM d JOIN p USING (ecosystem) JOIN ({_values([(e,) for e in M.VARIANT_ENDINGS])}) v(e) ON name = popular || e"""
)
def name_variants(spark, sf_dir):
    return M.name_variants(dealt(spark, sf_dir, _ASKED, "ecosystem", "name").select("ecosystem", "name").distinct(), popular_packages(spark))


@query(f"WITH d AS (SELECT DISTINCT ecosystem, name FROM {dealt_sql(_ASKED, 'ecosystem', 'name')}), p(ecosystem, popular) AS ({_values(_LISTED)}) SELECT name, popular FROM d JOIN p ON p.ecosystem = 'npm' AND d.ecosystem = 'npm' AND starts_with(name, '@') AND split_part(name, '/', 2) = popular WHERE NOT " + "(" + " OR ".join(f"starts_with(name, {_q(s)})" for s in M.OFFICIAL_SCOPES) + ")")
def scope_confusion(spark, sf_dir):
    return M.scope_confusion(dealt(spark, sf_dir, _ASKED, "ecosystem", "name").select("ecosystem", "name").distinct(), popular_packages(spark))


@query("SELECT 'orders/' || o_custkey || '/' AS folder FROM orders GROUP BY o_custkey HAVING max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END) > max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate END)")
def stale_lockfiles(spark, sf_dir):
    """Orders stand for files: even ones are manifests, odd ones lock files of their customer's folder."""
    name = F.when(F.col("o_orderkey") % 2 == 0, "package.json").otherwise("package-lock.json")
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("orders/"), F.col("o_custkey").cast("string"), F.lit("/"), name).alias("path"), F.col("o_orderdate").alias("mtime"))
    return M.stale_lockfiles(files)


@query(f"WITH {_PART}, c AS (SELECT {_SPDX} AS spdx, licence FROM p), k AS (SELECT *, {_CLASS.format('spdx')} AS class FROM c) SELECT CAST(least(100, sum(CASE WHEN licence IS NULL THEN 3 WHEN spdx IS NOT NULL AND class IN ('StrongCopyleft', 'Agpl') THEN 25 ELSE 0 END)) AS INTEGER) AS risk FROM k")
def supply_chain_risk(spark, sf_dir):
    return M.supply_chain_risk(M.tree_conflicts(_parts(spark, sf_dir).select("name", "licence"), "MIT").filter("reason <> 'SourceAvailableInOpenSource'"))
