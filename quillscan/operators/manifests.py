"""Lock files and manifests as dependency nodes: column expressions over ``path, text``, one parser per format.

A node has ``path, ecosystem, name, version, licence, expression, depends_on, linking, exceptions, build_only``.
Texts that are not of a format give no rows; nothing here collects anything.
"""

from __future__ import annotations

from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..functions.text import lines
from ..sources.files import file_name

UNKNOWN = "UNKNOWN"


def _names(value: Column | None = None) -> Column:
    return F.coalesce(value, F.array().cast("array<string>")) if value is not None else F.array().cast("array<string>")


def _node(rows: DataFrame, ecosystem: str, name: Column, version: Column, linking: Column | str, licence: Column | None = None, expression: Column | None = None, depends_on: Column | None = None, exceptions: Column | None = None, build_only: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "path",
        F.lit(ecosystem).alias("ecosystem"),
        name.alias("name"),
        version.alias("version"),
        F.coalesce(licence, F.lit(UNKNOWN)).alias("licence") if licence is not None else F.lit(UNKNOWN).alias("licence"),
        (none if expression is None else expression).alias("expression"),
        _names(depends_on).alias("depends_on"),
        (F.lit(linking) if isinstance(linking, str) else linking).alias("linking"),
        _names(exceptions).alias("exceptions"),
        (F.lit(False) if build_only is None else build_only).alias("build_only"),
    )


def npm_lock(files: DataFrame) -> DataFrame:
    """``packages`` of package-lock.json from version 2 on; only a leading node_modules/ is dropped from a name."""
    schema = "name string, packages map<string, struct<version: string, license: string, dev: boolean, dependencies: map<string, string>>>"
    rows = files.select("path", F.from_json("text", schema).alias("m")).filter("m.name IS NOT NULL").select("path", F.explode("m.packages").alias("key", "p")).filter("key <> ''")
    licence = F.when(~F.col("p.license").startswith("{"), F.col("p.license"))
    return _node(rows, "npm", F.regexp_replace("key", "^node_modules/", ""), F.col("p.version"), "Source", licence, F.coalesce(licence, F.lit(UNKNOWN)), F.map_keys("p.dependencies"), build_only=F.coalesce("p.dev", F.lit(False)))


def npm_lock_entries(files: DataFrame) -> DataFrame:
    """``path, name, version, licence, depends_on``: entries of a lock file of any version, nested ones to any depth.

    Version 1 nests ``dependencies``; each round opens one more level, until none is left.
    """
    any_ = "map<string, string>"
    new = files.select("path", F.from_json("text", "packages map<string, struct<version: string, license: string, dependencies: map<string, string>>>").alias("m")).filter("m.packages IS NOT NULL")
    new = new.select("path", F.explode("m.packages").alias("key", "p")).withColumn("name", F.regexp_replace("key", "^(node_modules/)+", "")).filter("name NOT IN ('', '.')")
    out = new.select("path", "name", F.coalesce("p.version", F.lit("0.0.0")).alias("version"), F.col("p.license").alias("licence"), _names(F.map_keys("p.dependencies")).alias("depends_on"), F.lit(0).alias("level"))
    old = files.select("path", F.get_json_object("text", "$.dependencies").alias("deps")).join(new.select("path").distinct(), "path", "left_anti").filter("deps IS NOT NULL")
    level = 0
    while not old.isEmpty():  # a level of nesting a round
        level += 1
        entry = old.select("path", F.explode(F.from_json("deps", any_)).alias("name", "info"))
        parsed = entry.select("path", "name", F.get_json_object("info", "$.version").alias("v"), F.from_json(F.get_json_object("info", "$.requires"), any_).alias("r"), F.get_json_object("info", "$.dependencies").alias("deps"))
        out = out.unionByName(parsed.select("path", "name", F.coalesce("v", F.lit("0.0.0")).alias("version"), F.lit(None).cast("string").alias("licence"), _names(F.map_keys("r")).alias("depends_on"), F.lit(level).alias("level")))
        old = parsed.select("path", "deps").filter("deps IS NOT NULL")
    return out


def cargo_metadata(files: DataFrame) -> DataFrame:
    """Packages of ``cargo metadata`` JSON with the dependencies of their resolve nodes."""
    schema = "packages array<struct<id: string, name: string, version: string, license: string, targets: array<struct<kind: array<string>>>>>, resolve struct<nodes: array<struct<id: string, deps: array<struct<name: string>>>>>"
    doc = files.select("path", F.from_json("text", schema).alias("m")).filter("m.packages IS NOT NULL")
    rows = doc.select("path", F.explode("m.packages").alias("p"), F.filter("m.resolve.nodes", lambda n: F.lit(True)).alias("nodes"))
    deps = F.element_at(F.filter("nodes", lambda n: n["id"] == F.col("p.id")), 1)["deps"]["name"]
    macro = F.coalesce(F.exists("p.targets", lambda t: F.array_contains(t["kind"], "proc-macro")), F.lit(False))
    raw = F.coalesce("p.license", F.lit(UNKNOWN))
    return _node(rows, "crates", F.col("p.name"), F.col("p.version"), F.when(macro, "ProcMacro").otherwise("Static"), F.split_part(raw, F.lit(" OR "), F.lit(1)), cargo_expression(raw), deps, cargo_exceptions(raw))


def cargo_expression(licence: Column) -> Column:
    """A manifest's licence field with / read as OR."""
    return F.replace(licence, F.lit("/"), F.lit(" OR "))


def cargo_exceptions(licence: Column) -> Column:
    """What follows the first WITH, up to a next one."""
    return F.when(licence.contains(" WITH "), F.array(F.trim(F.split_part(licence, F.lit(" WITH "), F.lit(2))))).otherwise(F.array().cast("array<string>"))


def cargo_lock(files: DataFrame) -> DataFrame:
    """``[[package]]`` blocks of Cargo.lock; only quoted entries with a space (name and version) become dependencies."""
    blocks = files.select("path", F.explode(F.split("text", r"\[\[package\]\]")).alias("b"))
    name, version = (F.regexp_extract("b", rf'(?m)^[ \t]*{k} = "*([^"\n]*)', 1) for k in ("name", "version"))
    deps = F.regexp_extract_all("b", F.lit(r'(?m)^[ \t]*"+([^" \t\n]+) [^\n]*$'), F.lit(1))
    rows = blocks.filter(name != "")
    return _node(rows, "crates", name, F.nullif(version, F.lit("")), "Static", depends_on=deps)


def go_sum(files: DataFrame) -> DataFrame:
    """First version of each module of go.sum."""
    rows = files.select("path", F.posexplode(lines(F.col("text"))).alias("no", "line")).withColumn("p", F.split(F.trim("line"), r"\s+")).filter("size(p) >= 2")
    first = rows.groupBy("path", F.element_at("p", 1).alias("name")).agg(F.min_by(F.regexp_replace(F.element_at("p", 2), r"/go\.mod$", ""), "no").alias("v"))
    return _node(first, "go", F.col("name"), F.col("v"), "Static")


def requirements(files: DataFrame) -> DataFrame:
    """Lines of requirements.txt, cut at == or else at >=."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = files.select("path", F.explode(lines(F.col("text"))).alias("line")).filter((line != "") & ~line.startswith("#") & ~line.startswith("-"))
    sign = F.when(line.contains("=="), "==").when(line.contains(">="), ">=")
    name = F.when(sign.isNull(), line).otherwise(F.trim(F.split_part(line, sign, F.lit(1))))
    return _node(rows, "pypi", name, F.when(sign.isNotNull(), F.trim(F.substr(line, F.position(sign, line) + 2))), "Source")


_PAIRS = MapType(StringType(), StringType())


@pandas_udf(ArrayType(StructType([StructField("tag", StringType()), StructField("attributes", _PAIRS), StructField("parts", _PAIRS)])))
def _elements(text: pd.Series, tags: pd.Series) -> pd.Series:
    """Elements of some names at any depth of XML texts, up to where a text is damaged: attributes, and texts of the parts right below.

    Name spaces are dropped; of parts that share a name the first counts.
    """
    local = lambda name: name.rsplit("}", 1)[-1]

    def one(value: str | None, wanted: str) -> list[dict]:
        reader, out = ElementTree.XMLPullParser(["end"]), []
        try:
            reader.feed(value or "")
        except ElementTree.ParseError:
            pass
        try:
            for _, e in reader.read_events():
                if isinstance(e.tag, str) and local(e.tag) in wanted.split(" "):
                    parts = {local(c.tag): c.text.strip() for c in reversed(e) if isinstance(c.tag, str) and c.text and c.text.strip()}
                    out.append({"tag": local(e.tag), "attributes": {local(k): v for k, v in e.attrib.items()}, "parts": parts})
        except ElementTree.ParseError:
            pass
        return out

    return pd.Series([one(t, w) for t, w in zip(text, tags, strict=True)])


def _of_xml(files: DataFrame, tags: str) -> DataFrame:
    return files.select("path", F.explode(_elements("text", F.lit(tags))).alias("e")).select("path", "e.*")


# Scopes and configurations that only building needs, and configurations that add to what is shipped.
BUILD_SCOPES = ["test", "provided", "system"]
BUILD_CONFIGURATIONS = ["testImplementation", "testCompileOnly", "annotationProcessor", "compileOnly"]
CONFIGURATIONS = ["implementation", "api", "runtimeOnly"]


def pom(files: DataFrame) -> DataFrame:
    """Dependencies of pom.xml as group:artifact; test, provided and system scopes are for building only."""
    of = lambda part: F.col("parts")[part]
    rows = _of_xml(files, "dependency").filter(of("groupId").isNotNull() & of("artifactId").isNotNull())
    return _node(rows, "maven", F.concat(of("groupId"), F.lit(":"), of("artifactId")), of("version"), "Static", build_only=F.coalesce(of("scope").isin(BUILD_SCOPES), F.lit(False)))


def gradle(files: DataFrame) -> DataFrame:
    """Dependencies of build.gradle: a configuration, then quoted coordinates; test, annotation and compile-only ones are for building only."""
    named = f"({'|'.join(BUILD_CONFIGURATIONS + CONFIGURATIONS)})"
    quoted = rf"""{named}\s*\(?\s*(?:'([^']+)'|"([^"]+)")"""
    rows = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(quoted), F.lit(0))).alias("m"))
    given = F.concat(F.regexp_extract("m", quoted, 2), F.regexp_extract("m", quoted, 3))
    rows = rows.select("path", F.regexp_extract("m", quoted, 1).alias("configuration"), F.split(given, ":").alias("c")).filter("size(c) > 1 AND c[0] <> '' AND c[1] <> ''")
    return _node(rows, "maven", F.concat(F.col("c")[0], F.lit(":"), F.col("c")[1]), F.nullif(F.get("c", F.lit(2)), F.lit("")), "Static", build_only=F.col("configuration").isin(BUILD_CONFIGURATIONS))


def nuget(files: DataFrame) -> DataFrame:
    """Package references of project files, and of packages.config those that no project file names."""
    of = lambda name: F.col("attributes")[name]
    refs = _of_xml(files.filter(F.col("path").rlike(r"\.(cs|fs)proj$")), "PackageReference").select("path", of("Include").alias("name"), F.coalesce(of("Version"), F.col("parts")["Version"]).alias("version")).filter("name <> ''")
    old = _of_xml(files.filter(file_name(F.col("path")) == "packages.config"), "package").select("path", of("id").alias("name"), of("version").alias("version")).filter("name <> '' AND version <> ''")
    named = refs.select("name").distinct().hint("merge")  # as many as files have: never sent to the driver
    rows = refs.unionByName(old.join(named, "name", "left_anti").select("path", "name", "version"))
    return _node(rows, "nuget", F.col("name"), F.col("version"), "Static")


def composer_lock(files: DataFrame) -> DataFrame:
    """Packages of composer.lock: the first licence counts, all of them make the expression; dev packages are for building only."""
    one = "array<struct<name: string, version: string, license: array<string>, require: map<string, string>>>"
    doc = files.select("path", F.from_json("text", f"packages {one}, `packages-dev` {one}").alias("m"))
    rows = doc.select("path", F.explode("m.packages").alias("p"), F.lit(False).alias("dev")).unionByName(doc.select("path", F.explode("m.packages-dev").alias("p"), F.lit(True).alias("dev"))).filter("p.name <> ''")
    needs = F.filter(F.map_keys("p.require"), lambda k: ~k.startswith("php") & ~k.startswith("ext-"))
    return _node(
        rows, "composer", F.col("p.name"), F.col("p.version"), "Source", F.get("p.license", F.lit(0)), F.when(~F.col("dev"), F.array_join("p.license", " OR ")), F.when(~F.col("dev"), needs), build_only=F.col("dev")
    )


def gemfile_lock(files: DataFrame) -> DataFrame:
    """Gems of the GEM section of Gemfile.lock (four spaces) with their dependencies (six spaces)."""
    section = F.regexp_extract("text", r"(?m)^GEM\n((?:[ \t]+[^\n]*\n?|\n)*)", 1)
    rows = files.select("path", F.explode(F.regexp_extract_all(section, F.lit(r"(?m)^ {4}\S+ +\([^)]+\)[^\n]*\n?(?: {6}\S[^\n]*\n?)*"), F.lit(0))).alias("b"))
    deps = F.regexp_extract_all("b", F.lit(r"(?m)^ {6}(\S+)"), F.lit(1))
    return _node(rows, "gems", F.regexp_extract("b", r"^ {4}(\S+)", 1), F.regexp_extract("b", r"^ {4}\S+ +\(([^)]+)\)", 1), "Source", depends_on=deps)


PARSERS = {
    "package-lock.json": npm_lock, "metadata.json": cargo_metadata, "Cargo.lock": cargo_lock, "go.sum": go_sum, "requirements.txt": requirements, "pom.xml": pom, "build.gradle": gradle, "build.gradle.kts": gradle,
    "composer.lock": composer_lock, "Gemfile.lock": gemfile_lock,
}


def dependency_nodes(files: DataFrame) -> DataFrame:
    """Nodes of every lock file and manifest of ``files``, told by their names; one scan per format, filtered before parsing."""
    name = file_name(F.col("path"))
    parts = [parse(files.filter(name == n)) for n, parse in PARSERS.items()]
    return reduce(DataFrame.unionByName, [*parts, nuget(files)])


# ---------------------------------------------------------------- trees: direct and further dependencies


def go_mod(files: DataFrame) -> DataFrame:
    """``path, name, version, depth`` of go.mod: indirect requirements have depth 2."""
    block = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*require \(([^)]*)\)"), F.lit(1))
    single = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*require ([^(\n][^\n]*)$"), F.lit(1))
    rows = files.select("path", F.explode(F.concat(F.flatten(F.transform(block, lambda b: F.split(b, "\n"))), single)).alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter(~F.col("line").startswith("//"))
    part = F.split("line", r"\s+")
    return rows.filter(F.size(part) >= 2).select("path", F.get(part, F.lit(0)).alias("name"), F.get(part, F.lit(1)).alias("version"), F.when(F.col("line").contains("// indirect"), 2).otherwise(1).alias("depth"))


def npm_manifest(files: DataFrame) -> DataFrame:
    """``path, name, version, depth`` of package.json: dependencies, then development ones of other names."""
    rows = files.select("path", F.from_json("text", "dependencies map<string, string>, devDependencies map<string, string>").alias("m"))
    merged = F.map_concat(F.map_filter(F.coalesce("m.devDependencies", F.expr("map()").cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key("m.dependencies", k), F.lit(False))), F.coalesce("m.dependencies", F.expr("map()").cast("map<string,string>")))
    return rows.select("path", F.explode(merged).alias("name", "version")).select("path", "name", "version", F.lit(1).alias("depth"))


def composer_manifest(files: DataFrame) -> DataFrame:
    """``path, name, version, depth`` of composer.json without php and extensions."""
    rows = files.select("path", F.explode(F.from_json(F.get_json_object("text", "$.require"), "map<string, string>")).alias("name", "version"))
    return rows.filter((F.col("name") != "php") & ~F.col("name").startswith("ext-")).select("path", "name", "version", F.lit(1).alias("depth"))


def npm_tree(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """``project, name, version, licence, depends_on, depth``: manifest entries overlaid with the lock file's of the same folder, others at depth 2."""
    project = F.regexp_replace("path", "(^|/)[^/]*$", "").alias("project")
    top = npm_manifest(manifests).select(project, "name", F.col("version").alias("v"), F.col("depth").alias("d"))
    lock = npm_lock_entries(locks).groupBy(project, "name").agg(F.max_by(F.struct("version", "licence", "depends_on"), "level").alias("l"))  # the deepest entry of a name holds
    both = top.join(lock, ["project", "name"], "full")
    return both.select("project", "name", F.coalesce("l.version", "v").alias("version"), F.col("l.licence").alias("licence"), _names(F.col("l.depends_on")).alias("depends_on"), F.coalesce("d", F.lit(2)).alias("depth"))


# Spellings of licences and the ids they stand for.
SPDX_SPELLINGS = [
    ("MIT", "MIT"), ("ISC", "ISC"), ("APACHE-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0-ONLY", "GPL-2.0-only"), ("GPL-2.0-OR-LATER", "GPL-2.0-or-later"), ("GPL-2.0+", "GPL-2.0-or-later"),
    ("GPL-3.0", "GPL-3.0-only"), ("GPL-3.0-ONLY", "GPL-3.0-only"), ("GPL-3.0-OR-LATER", "GPL-3.0-or-later"), ("GPL-3.0+", "GPL-3.0-or-later"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1-ONLY", "LGPL-2.1-only"),
    ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0-ONLY", "LGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0-ONLY", "AGPL-3.0-only"), ("MPL-2.0", "MPL-2.0"), ("BSL-1.0", "BSL-1.1"), ("BSL-1.1", "BSL-1.1"),
    ("BUSL-1.1", "BSL-1.1"), ("UNLICENSE", "Unlicense"), ("CC0-1.0", "CC0-1.0"), ("0BSD", "0BSD"),
]
SPDX_PARTS = [("BSD", "BSD-3-Clause"), ("MIT", "MIT"), ("APACHE", "Apache-2.0")]
# Parts of an id and the class they mean; the first that holds counts.
LICENCE_CLASSES = [
    ("agpl", "Agpl"), ("gpl", "StrongCopyleft"), ("lgpl", "WeakCopyleft"), ("mpl", "WeakCopyleft"), ("cddl", "WeakCopyleft"), ("epl", "WeakCopyleft"), ("sspl", "SourceAvailable"), ("bsl", "SourceAvailable"), ("elastic", "SourceAvailable"),
    ("mit", "Permissive"), ("bsd", "Permissive"), ("apache", "Permissive"), ("isc", "Permissive"), ("unlicense", "Permissive"), ("zlib", "Permissive"), ("cc0", "Permissive"), ("proprietary", "Proprietary"), ("commercial", "Proprietary"),
]


def spdx_of(spelling: Column) -> Column:
    """The licence id that a spelling stands for; null if none."""
    up = F.upper(F.trim(spelling))
    return F.coalesce(*(F.when(up == s, F.lit(i)) for s, i in SPDX_SPELLINGS), *(F.when(up.contains(s), F.lit(i)) for s, i in SPDX_PARTS))


def licence_class(licence: Column) -> Column:
    low = F.lower(licence)
    return F.coalesce(*(F.when(low.contains(s), F.lit(c)) for s, c in LICENCE_CLASSES), F.lit("Unknown"))


def tree_conflicts(tree: DataFrame, project: str) -> DataFrame:
    """``name, licence, reason, severity``: dependencies of ``name, licence`` that the project's licence cannot take in."""
    known = spdx_of(F.col("licence"))
    mine, own = licence_class(F.lit(project)), licence_class(known)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("licence").isNull(), F.struct(F.lit("UnknownLicense").alias("reason"), F.lit("Warning").alias("severity"))),
            F.when((mine == "Permissive") & (own == "StrongCopyleft") & known.isNotNull(), F.struct(F.lit("CopyleftInPermissive").alias("reason"), F.lit("Critical").alias("severity"))),
            F.when((own == "Agpl") & (mine != "Agpl"), F.struct(F.lit("AgplContamination").alias("reason"), F.lit("Critical").alias("severity"))),
            F.when((own == "SourceAvailable") & ~mine.isin("SourceAvailable", "Proprietary"), F.struct(F.lit("SourceAvailableInOpenSource").alias("reason"), F.lit("Error").alias("severity"))),
        )
    )
    return tree.select("name", "licence", F.explode(reasons).alias("r")).select("name", "licence", "r.reason", "r.severity")


# ---------------------------------------------------------------- further supply-chain checks

# Endings of variants of a package, and scopes that publish officially.
VARIANT_ENDINGS = ["-js", "-ts", "-node", "-core", "node-", "js-", "python-", "py-", "-cli", "-lib", "-utils"]
OFFICIAL_SCOPES = [
    "@angular/", "@vue/", "@react-native/", "@babel/", "@types/", "@emotion/", "@sentry/", "@mui/", "@nestjs/", "@apollo/", "@prisma/", "@vercel/", "@aws-sdk/", "@google-cloud/", "@azure/", "@octokit/", "@testing-library/",
]


def name_variants(deps: DataFrame, popular: DataFrame) -> DataFrame:
    """``ecosystem, name, popular, flag``: names that differ from a popular one in separators, or add an ending to it.

    Both meet by equality on a key, so the popular table is only looked up.
    """
    plain = lambda c: F.translate(c, "-.", "__")
    known = popular.select("ecosystem", "popular", F.explode(F.concat(F.array(F.struct(F.lit("separator").alias("flag"), plain(F.col("popular")).alias("key"))), F.array(*(F.struct(F.lit("variant").alias("flag"), F.concat("popular", F.lit(e)).alias("key")) for e in VARIANT_ENDINGS)))).alias("k"))
    known = known.select("ecosystem", "popular", "k.flag", "k.key")
    asked = deps.select("ecosystem", "name", F.explode(F.array(F.struct(F.lit("separator").alias("flag"), plain(F.col("name")).alias("key")), F.struct(F.lit("variant").alias("flag"), F.col("name").alias("key")))).alias("k")).select("ecosystem", "name", "k.flag", "k.key")
    return asked.join(F.broadcast(known), ["ecosystem", "flag", "key"]).filter("name <> popular").select("ecosystem", "name", "popular", "flag").distinct()


def scope_confusion(deps: DataFrame, popular: DataFrame) -> DataFrame:
    """``name, popular`` of scoped npm packages of no official scope that bear a popular package's name."""
    scoped = deps.filter((F.col("ecosystem") == "npm") & F.col("name").startswith("@")).filter(~F.col("name").rlike("^(" + "|".join(OFFICIAL_SCOPES) + ")"))
    return scoped.select("name", F.split_part("name", F.lit("/"), F.lit(2)).alias("popular")).join(F.broadcast(popular.filter("ecosystem = 'npm'").select("popular")), "popular").select("name", "popular")


def stale_lockfiles(files: DataFrame) -> DataFrame:
    """``folder`` of each manifest that is younger than the lock file beside it; ``files`` has ``path, mtime``."""
    folder, name = F.regexp_replace("path", r"[^/\\]+$", ""), file_name(F.col("path"))
    at = lambda n: F.max(F.when(name == n, F.col("mtime")))
    both = files.filter(name.isin("package.json", "package-lock.json")).groupBy(folder.alias("folder")).agg(at("package.json").alias("manifest"), at("package-lock.json").alias("lock"))
    return both.filter("manifest > lock").select("folder")


# Points of supply-chain and data-rights findings.
SUPPLY_CHAIN_POINTS = {"Critical": 25, "High": 10, "Warning": 3, "Info": 1}


def supply_chain_risk(findings: DataFrame) -> DataFrame:
    """One row ``risk``: points by severity, at most 100."""
    points = F.coalesce(*(F.when(F.col("severity") == s, F.lit(p)) for s, p in SUPPLY_CHAIN_POINTS.items()), F.lit(0))
    return findings.agg(F.least(F.lit(100), F.coalesce(F.sum(points), F.lit(0))).cast("int").alias("risk"))
