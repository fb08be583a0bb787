"""Copyleft contamination along dependency edges, by breadth-first rounds."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from ..functions.license import family, is_copyleft
from ..refdata import COPYLEFT, FAMILY_RULES
from ..refdata_licences import LINK_FACTORS, NEUTRALISING
from ..storage import written


def propagates(fam: Column, linking: Column) -> Column:
    """How surely a licence family reaches a dependent over a kind of linking; 0 where it does not."""
    return (
        F.when(fam == "NetworkCopyleft", F.lit(1.0))
        .when((fam == "StrongCopyleft") & linking.isin("Static", "Source"), F.lit(1.0))
        .when((fam == "StrongCopyleft") & (linking == "Dynamic"), F.lit(0.8))
        .when((fam == "WeakCopyleft") & (linking == "Static"), F.lit(0.9))
        .otherwise(F.lit(0.0))
    )


def crosses(fam: Column, linking: Column) -> Column:
    """Whether a licence family passes to a dependent that is linked so; unknown linking passes."""
    how = F.coalesce(linking, F.lit("Unknown"))
    tools = ["BuildTool", "ProcMacro"]
    return (
        F.when(fam == "NetworkCopyleft", ~how.isin(tools))
        .when(fam == "StrongCopyleft", ~how.isin([*tools, "IpcNetwork"]))
        .when(fam == "WeakCopyleft", ~how.isin([*tools, "IpcNetwork", "Dynamic", "HeaderOnly"]))
        .otherwise(F.lit(False))
    )


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting: rounds join the graph again and again, and a broadcast takes it through the driver each time."""
    return left.join(right.hint("merge"), on, how)


def contaminated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``package, source, family, depth``: least depth at which a copyleft source reaches a package.

    ``nodes``: ``name, licence, linking``; ``edges``: ``src`` depends on ``dst``.  A source
    whose licence does not cross its own linking reaches nobody, and it does not pass to a
    dependent whose linking it does not cross.  Copyleft packages pass it on but are not
    reported.  Each round goes one edge on from the (package, source) rows that the last one
    found first, until there are none: depth has no bound and no path is walked twice.
    """
    marked = nodes.withColumn("family", family(F.col("licence")))
    known = marked.select(F.col("name").alias("package"), "linking", F.coalesce(is_copyleft(F.col("family")), F.lit(False)).alias("own"))
    arcs = written(_merged(edges.select("src", "dst"), known.withColumnRenamed("package", "src"), "src").select("dst", F.col("src").alias("package"), "linking", "own"), "arcs")
    keys = ["package", "source", "family"]
    sources = marked.filter(propagates(F.col("family"), F.col("linking")) > 0).select(F.col("name").alias("package"), F.col("name").alias("source"), "family", F.lit(True).alias("own"), F.lit(0).alias("depth"))
    seen = front = written(sources.dropDuplicates(keys), "contamination")
    depth = 0
    while not front.isEmpty():
        depth += 1
        reached = _merged(front.select(F.col("package").alias("dst"), "source", "family"), arcs, "dst")
        passed = reached.filter(crosses(F.col("family"), F.col("linking"))).select(*keys, "own").dropDuplicates(keys)
        front = written(_merged(passed, seen.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)).select(*keys, "own", "depth"), "contamination")
        seen = seen.unionByName(front)
        if depth % 16 == 0:  # keeps the plan short
            seen = written(seen, "contamination")
    return seen.filter(~F.col("own") & (F.col("package") != F.col("source"))).select(*keys, "depth")


# ---------------------------------------------------------------- trace over dependency nodes


def _family_of(licence: str) -> str:
    """:func:`family` of one id, for expressions that are taken apart in Python."""
    bare = re.sub(r"\++$", "", re.sub("(-OR-LATER)+$", "", re.sub("(-ONLY)+$", "", licence.upper())))
    for name, kind, value in FAMILY_RULES:
        if {"prefix": bare.startswith(value), "equal": bare == value}.get(kind, all(v in bare for v in value.split("|"))):
            return name
    return "Unknown"


def _cut(text: str, word: str) -> tuple[str, str] | None:
    """The text before and after the first ``word`` outside parentheses."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if not depth and text.startswith(word, i):
            return text[:i], text[i + len(word) :]
    return None


_STRENGTH = {"NetworkCopyleft": 3, "StrongCopyleft": 2, "WeakCopyleft": 1}


def _choices(text: str) -> tuple[list[str], bool, bool, str | None]:
    """Licences of an expression, whether one is copyleft, whether a choice avoids that, and the family that cannot be avoided."""
    text = text.strip()
    while text.startswith("(") and text.endswith(")") and _cut(text[1:-1] + " ", ")") is None and text.count("(") == text.count(")"):
        text = text[1:-1].strip()
    for word in (" OR ", " AND "):
        if parts := _cut(text, word):
            (la, ca, pa, fa), (lb, cb, pb, fb) = map(_choices, parts)
            free = pa or pb if word == " OR " else pa and pb
            family_ = None if word == " OR " and free else max((f for f in (fa, fb) if f), key=lambda f: _STRENGTH.get(f, 0), default=None)
            return la + lb, ca or cb, free, family_
    base, _, exception = text.partition(" WITH ")
    own = _family_of(base.strip())
    copyleft = own in COPYLEFT and not (exception and any(e.lower() in exception.lower() for e in NEUTRALISING))
    return [base.strip()], copyleft, not copyleft, own if copyleft else None


@pandas_udf(StructType().add("licences", ArrayType(StringType())).add("has_copyleft", BooleanType()).add("permissive_choice", BooleanType()).add("effective", StringType()))
def choices(expression: pd.Series) -> pd.DataFrame:
    """What an SPDX expression asks for; each distinct expression is taken apart once."""
    known = {e: _choices(e) for e in expression.dropna().unique()}
    none = (None, None, None, None)
    return pd.DataFrame([known.get(e, none) for e in expression], columns=["licences", "has_copyleft", "permissive_choice", "effective"])


def is_neutralised(exceptions: Column) -> Column:
    return F.exists(exceptions, lambda e: F.lower(e).rlike("|".join(re.escape(n.lower()) for n in NEUTRALISING)))


def copyleft_sources(nodes: DataFrame) -> DataFrame:
    """``nodes`` that are copyleft with ``family`` and ``fate``: active, neutralised by an exception, avoidable by choice, or build only."""
    asked = nodes.withColumn("_c", choices(F.coalesce("expression", "licence")))
    own = family(F.col("licence"))
    fate = (
        F.when(is_neutralised(F.col("exceptions")) & is_copyleft(own), "neutralised").when(F.col("_c.has_copyleft") & F.col("_c.permissive_choice"), "avoidable")
        .when(F.col("_c.effective").isNotNull(), F.when(F.col("build_only"), "build only").otherwise("active"))
    )
    return asked.withColumns({"fate": fate, "family": F.coalesce("_c.effective", own), "effective": F.col("_c.effective")}).drop("_c")


def trace(nodes: DataFrame) -> DataFrame:
    """``package, licence, source, source_licence, family, depth, confidence, chain`` of packages that copyleft reaches.

    ``nodes`` as :mod:`.manifests` gives them.  Neutralised, avoidable and build-only sources
    reach nobody; build-only dependents are passed over; packages that cannot avoid copyleft
    themselves pass it on but are not reported.  Only the dependent's linking counts.  A
    (package, source) pair is reached once, at its least depth, by the surest chain.  Rounds
    go one edge on from what was new in the last one, so depth has no bound.
    """
    known = written(copyleft_sources(nodes), "nodes")
    edges = known.select(F.col("name").alias("src"), F.explode("depends_on").alias("dst")).distinct()
    dependents = known.filter(~F.col("build_only")).select(F.col("name").alias("package"), "linking", F.col("licence").alias("own"), F.col("effective").isNull().alias("reported"))
    arcs = written(_merged(edges, dependents.withColumnRenamed("package", "src"), "src").withColumnRenamed("src", "package"), "arcs")
    factor = F.coalesce(*(F.when(F.col("linking") == k, F.lit(v)) for k, v in LINK_FACTORS.items()), F.lit(0.5))
    keys = ["package", "source"]
    start = known.filter("fate = 'active'").select(F.col("name").alias("package"), F.col("name").alias("source"), F.col("licence").alias("source_licence"), "family", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.array("name").alias("chain"), F.lit(False).alias("reported"), F.col("licence"))
    columns = ["package", "source", "source_licence", "family", "depth", "confidence", "chain", "reported", "licence"]
    seen = front = written(start.select(columns).dropDuplicates(keys), "trace")
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = _merged(front.select(F.col("package").alias("dst"), "source", "source_licence", "family", "confidence", "chain"), arcs, "dst")
        step = step.filter(crosses(F.col("family"), F.col("linking"))).withColumn("confidence", F.col("confidence") * factor).withColumn("chain", F.concat("chain", F.array("package")))
        best = step.groupBy(keys).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "chain", "source_licence", "family", "reported", "own")).alias("b"))
        new = _merged(best, seen.select(keys), keys, "left_anti")
        front = written(new.select(*keys, "b.source_licence", "b.family", F.lit(depth).alias("depth"), (-F.col("b.c")).alias("confidence"), "b.chain", "b.reported", F.col("b.own").alias("licence")).select(columns), "trace")
        seen = seen.unionByName(front)
        if depth % 16 == 0:  # keeps the plan short
            seen = written(seen, "trace")
    return seen.filter("reported").select("package", "licence", "source", "source_licence", "family", "depth", "confidence", "chain")


def trace_findings(found: DataFrame, sources: DataFrame, project_licence: str) -> DataFrame:
    """``vtype, package, severity, confidence``: reached packages by confidence, unless the project is copyleft itself, and avoidable sources."""
    c = F.col("confidence")
    severity = F.when(c > 0.9, "Critical").when(c > 0.7, "High").when(c > 0.5, "Medium").otherwise("Low")
    reached = found.filter(~is_copyleft(family(F.lit(project_licence)))).select(F.lit("CopyleftInProprietary").alias("vtype"), "package", severity.alias("severity"), "confidence")
    avoidable = sources.filter("fate = 'avoidable'").select(F.lit("DualLicenseMisuse").alias("vtype"), F.col("name").alias("package"), F.lit("Low").alias("severity"), F.lit(0.85).alias("confidence"))
    return reached.unionByName(avoidable)
