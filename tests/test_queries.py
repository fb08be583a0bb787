"""Every further query with SQL against DuckDB on the smallest tables, and edge cases that tables do not hold."""

import os

import pytest
from pyspark.sql import functions as F

from quillscan import catalog
from quillscan.operators import contamination, forensics, licences, manifests, web_assets
from quillscan.queries.contamination import _EXPECTED

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, q in catalog.QUERIES.items() if q.__module__.startswith("quillscan.queries") and n in catalog.ORACLE_SQL)
NODE = "name string, licence string, expression string, depends_on array<string>, linking string, exceptions array<string>, build_only boolean"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "part", "orders", "lineitem", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    want = duck.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = sorted(repr(tuple(r)) for r in got.select(*order).collect())
    assert rows == sorted(repr(r) for r in want.select(", ".join(f'"{c}"' for c in order)).fetchall())


def test_expression_choices(spark):
    got = catalog.QUERIES["expression_choices"](spark, SF).collect()
    assert {tuple(r)[1:] for r in got} == set(_EXPECTED)  # after the part


def _node(name, licence, deps=(), linking="Static", exceptions=(), build_only=False, expression=None):
    return (name, licence, expression, list(deps), linking, list(exceptions), build_only)


def test_trace_has_no_bound(spark):
    """A chain of 50 packages, a cycle, and a lattice whose paths cannot be walked one by one."""
    chain = [_node(f"c{k}", "MIT", [f"c{k - 1}"] if k else []) for k in range(1, 50)] + [_node("c0", "GPL-3.0-only")]
    cycle = [_node("x", "MIT", ["y", "g"]), _node("y", "MIT", ["x"]), _node("g", "AGPL-3.0-only", linking="Dynamic")]
    lattice = [_node(f"l{a}-{b}", "MIT", [f"l{a - 1}-{c}" for c in range(8)] if a else ["root"]) for a in range(10) for b in range(8)] + [_node("root", "GPL-2.0-only")]
    found = contamination.trace(spark.createDataFrame(chain + cycle + lattice, NODE)).collect()
    by = {(r.package, r.source): r for r in found}
    assert len(by) == len(found) == 49 + 2 + 80
    assert by["c49", "c0"].depth == 49 and len(by["c49", "c0"].chain) == 50 and by["y", "g"].depth == 2 and by["l9-3", "root"].depth == 10


def test_trace_rules(spark):
    nodes = [
        _node("app", "MIT", ["lib"], "Dynamic"),
        _node("lib", "LGPL-2.1-only"),
        _node("tool", "MIT", ["gcc"], "BuildTool"),
        _node("gcc", "GPL-3.0-only"),
        _node("java", "MIT", ["cp", "dual", "dev"]),
        _node("cp", "GPL-2.0-only", exceptions=["Classpath-exception-2.0"]),
        _node("dual", "GPL-2.0-only", expression="GPL-2.0-only OR MIT"),
        _node("dev", "GPL-2.0-only", build_only=True),
        _node("svc", "MIT", ["agpl"], "IpcNetwork"),
        _node("agpl", "AGPL-3.0-only"),
    ]
    df = spark.createDataFrame(nodes, NODE)
    assert [(r.package, r.confidence) for r in contamination.trace(df).collect()] == [("svc", 0.5)]
    assert {r.name: r.fate for r in contamination.copyleft_sources(df).filter("fate IS NOT NULL").collect()} == {"lib": "active", "gcc": "active", "cp": "neutralised", "dual": "avoidable", "dev": "build only", "agpl": "active"}
    assert contamination.trace(spark.createDataFrame([], NODE)).count() == 0


def test_forensics_on_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "MIT " * 3000)], "ord long, text string")
    got = {r.ord: r for r in forensics.analyse(rows, F.lit("MIT")).collect()}
    assert len(got) == 3 and got[2].trust == 0.45 and got[3].trust == 0.65  # two clauses of 0.15 and one of 0.05 are missing; a short text costs 0.2
    assert forensics.unicode_anomalies(rows).count() == 0


def test_policy_file():
    p = licences.policy_from_toml('blocked_licenses = ["GPL-3.0-only"]\nmax_risk_score = 40\n[[overrides]]\nname = "left"\nignore = true\n')
    assert p.blocked == ["GPL-3.0-only"] and p.ignored == ["left"] and p.max_risk_score == 40 and p.allowed == []
    assert licences.policy_from_toml("not toml [") == licences.policy_from_toml(None) == licences.LicencePolicy()


def test_parsers_skip_other_texts(spark):
    rows = spark.createDataFrame([("a/package-lock.json", "{broken"), ("a/Cargo.lock", ""), ("a/go.sum", None), ("a/pom.xml", "<x/>"), ("a/composer.lock", "[]"), ("a/Gemfile.lock", "x"), ("a/metadata.json", "{}"), ("a/x.csproj", "")], "path string, text string")
    assert manifests.dependency_nodes(rows).count() == 0


def test_web_detectors_on_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "unpkg.com")], "key long, text string")
    assert [tuple(r)[:4] for r in web_assets.cdn_references(rows).collect()] == [(3, 1, "Unpkg", "")]
    assert web_assets.source_maps(rows).count() == web_assets.font_faces(rows).count() == 0


def test_xml_in_any_shape(spark):
    """Orders of parts, name spaces, comments, entities, damage."""
    rows = [
        ("a/pom.xml", "<p xmlns='u'><dependency><!-- c --><artifactId>x</artifactId><version/><groupId>g&amp;h</groupId><groupId>late</groupId></dependency><dependency><groupId>only</groupId></dependency><dependency><groupId>cut</groupId>"),
        ("a/pom.xml", None), ("b/pom.xml", "not xml <dependency>"), ("a/build.gradle", "api 'a:b'\napi('c')\napi \":d\"\nruntimeOnly ( \"e:f:1:x\" )\nkaptTest 'g:h'"),
        ("a/b.csproj", "﻿<Project xmlns='m'><ItemGroup><PackageReference Include='N'>\n<Version> 2 </Version></PackageReference><PackageReference Update='U'/></ItemGroup></Project>"),
        ("a/packages.config", "<packages><package id='N' version='1'/><package id='O'/><package id='P' version='3'/></packages>"),
    ]
    found = manifests.dependency_nodes(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted((r.name, r.version, r.build_only) for r in found) == [("N", "2", False), ("P", "3", False), ("a:b", None, False), ("e:f", "1", False), ("g&h:x", None, False)]


def test_rounds_send_no_table_through_the_driver(spark):
    """The graph is small enough to be broadcast, but rounds join it again and again."""
    a = spark.range(3).withColumnRenamed("id", "dst")
    for how in ("inner", "left_anti"):
        plan = contamination._merged(a, a, "dst", how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_names_of_project_files_are_not_broadcast(spark):
    # All their names went to the driver, to be sent to every task.
    rows = [(f"{k}/app.csproj", f'<P><PackageReference Include="N{k}" Version="1"/></P>') for k in range(20)] + [(f"{k}/packages.config", f'<p><package id="N{k}" version="2"/></p>') for k in range(15, 25)]
    found = manifests.nuget(spark.createDataFrame(rows, "path string, text string"))
    assert sorted((r.name, r.version) for r in found.collect()) == sorted([(f"N{k}", "1") for k in range(20)] + [(f"N{k}", "2") for k in range(20, 25)])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
