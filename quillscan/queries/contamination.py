"""Contamination over a dependency graph made from the part table: part k depends on parts 2k and 2k + 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata_licences as L
from ..catalog import _family_sql, dealt, dealt_sql, query
from ..operators import contamination as C

_LICENCE = "['GPL-3.0-only', 'MIT', 'Apache-2.0', 'LGPL-2.1-only', 'MIT', 'AGPL-3.0-only', 'BSD-3-Clause']"
_LINKING = "['Static', 'Dynamic', 'Source', 'BuildTool', 'IpcNetwork', 'HeaderOnly', 'Static', 'Source']"


def _nodes(spark, sf_dir):
    """``p`` parts with licences, linking, exceptions, choices and build-only marks dealt by their key."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    most = parts.agg(F.max("k")).first()[0]
    return parts.withColumn("most", F.lit(most)).selectExpr(
        "concat('p', k) AS name", f"element_at(array({_LICENCE[1:-1]}), cast(k % 7 + 1 AS int)) AS licence", "CASE WHEN k % 14 = 5 THEN 'AGPL-3.0-only OR MIT' WHEN k % 28 = 7 THEN 'GPL-2.0-only WITH Bison-exception-2.2' END AS expression",
        "filter(array(CASE WHEN 2 * k <= most THEN concat('p', 2 * k) END, CASE WHEN 2 * k + 1 <= most THEN concat('p', 2 * k + 1) END), x -> x IS NOT NULL) AS depends_on", f"element_at(array({_LINKING[1:-1]}), cast(k % 8 + 1 AS int)) AS linking",
        "CASE WHEN k % 21 = 0 THEN array('Classpath-exception-2.0') ELSE cast(array() AS array<string>) END AS exceptions", "k % 13 = 0 AS build_only",
    )


_FACTOR = "CASE linking " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in L.LINK_FACTORS.items()) + " ELSE 0.5::DOUBLE END"
_GRAPH = f"""n AS (SELECT k, 'p' || k AS name, {_LICENCE}[k % 7 + 1] AS licence, {_LINKING}[k % 8 + 1] AS linking, k % 21 = 0 AS excepted, k % 13 = 0 AS build_only,
  CASE WHEN k % 14 = 5 THEN 'dual' WHEN k % 28 = 7 THEN 'with' ELSE 'plain' END AS kind FROM (SELECT p_partkey AS k FROM part)),
f AS (SELECT *, {_family_sql('licence')} AS own FROM n),
g AS (SELECT *, own IN ('StrongCopyleft', 'WeakCopyleft', 'NetworkCopyleft') AS copyleft, CASE WHEN kind = 'plain' AND own IN ('StrongCopyleft', 'WeakCopyleft', 'NetworkCopyleft') THEN own END AS effective FROM f),
s AS (SELECT *, CASE WHEN excepted AND copyleft THEN 'neutralised' WHEN kind = 'dual' THEN 'avoidable' WHEN effective IS NOT NULL THEN CASE WHEN build_only THEN 'build only' ELSE 'active' END END AS fate FROM g)"""
_TRACE = f"""{_GRAPH},
t(source, source_licence, family, k, depth, confidence) AS (
  SELECT name, licence, effective, k, 0, 1.0::DOUBLE FROM s WHERE fate = 'active'
  UNION ALL SELECT t.source, t.source_licence, t.family, s.k, t.depth + 1, t.confidence * {_FACTOR} FROM t JOIN s ON s.k = t.k // 2 WHERE NOT s.build_only AND NOT s.linking IN ('BuildTool', 'ProcMacro') AND (t.family = 'NetworkCopyleft' OR s.linking <> 'IpcNetwork') AND (t.family <> 'WeakCopyleft' OR s.linking NOT IN ('Dynamic', 'HeaderOnly'))),
r AS (SELECT s.name AS package, s.licence, t.source, t.source_licence, t.family, t.depth, t.confidence FROM t JOIN s USING (k) WHERE t.depth > 0 AND s.effective IS NULL)"""


@query(f"WITH RECURSIVE {_TRACE} SELECT package, licence, source, source_licence, family, depth, round(confidence, 9) AS confidence FROM r")
def contamination_trace(spark, sf_dir):
    return C.trace(_nodes(spark, sf_dir)).drop("chain").withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {_GRAPH} SELECT name, licence, CASE WHEN effective IS NOT NULL THEN effective ELSE own END AS family, fate FROM s WHERE fate IS NOT NULL")
def copyleft_sources(spark, sf_dir):
    return C.copyleft_sources(_nodes(spark, sf_dir)).filter("fate IS NOT NULL").select("name", "licence", "family", "fate")


@query(
    f"WITH RECURSIVE {_TRACE}, v AS (SELECT 'CopyleftInProprietary' AS vtype, CASE WHEN round(confidence, 9) > 0.9 THEN 'Critical' WHEN round(confidence, 9) > 0.7 THEN 'High' WHEN round(confidence, 9) > 0.5 THEN 'Medium' ELSE 'Low' END AS severity FROM r UNION ALL SELECT 'DualLicenseMisuse', 'Low' FROM s WHERE fate = 'avoidable') SELECT vtype, severity, count(*) AS findings FROM v GROUP BY ALL"
)
def contamination_findings(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    found = C.trace(nodes).withColumn("confidence", F.round("confidence", 9))
    return C.trace_findings(found, C.copyleft_sources(nodes), "MIT").groupBy("vtype", "severity").agg(F.count("*").alias("findings"))


_EXPRESSIONS = ["MIT", "MIT OR Apache-2.0", "GPL-2.0-only OR MIT", "GPL-2.0-only WITH Classpath-exception-2.0", "(MIT OR Apache-2.0) AND CC-BY-4.0", "GPL-3.0-only AND LGPL-2.1-only", "(GPL-2.0-only OR AGPL-3.0-only) AND MIT"]
_EXPECTED = [
    ("MIT", "MIT", False, True, None),
    ("MIT OR Apache-2.0", "MIT,Apache-2.0", False, True, None),
    ("GPL-2.0-only OR MIT", "GPL-2.0-only,MIT", True, True, None),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only", False, True, None),
    ("(MIT OR Apache-2.0) AND CC-BY-4.0", "MIT,Apache-2.0,CC-BY-4.0", False, True, None),
    ("GPL-3.0-only AND LGPL-2.1-only", "GPL-3.0-only,LGPL-2.1-only", True, False, "StrongCopyleft"),
    ("(GPL-2.0-only OR AGPL-3.0-only) AND MIT", "GPL-2.0-only,AGPL-3.0-only,MIT", True, False, "NetworkCopyleft"),
]


@query("SELECT part, expression, licences, has_copyleft, permissive_choice, effective FROM " + dealt_sql(_EXPECTED, "expression", "licences", "has_copyleft", "permissive_choice", "effective"))
def expression_choices(spark, sf_dir):
    """What fixed expressions ask for; a test holds the expected rows."""
    rows = dealt(spark, sf_dir, [(e,) for e in _EXPRESSIONS], "expression").withColumn("c", C.choices("expression"))
    return rows.select("part", "expression", F.array_join("c.licences", ",").alias("licences"), "c.has_copyleft", "c.permissive_choice", "c.effective")
