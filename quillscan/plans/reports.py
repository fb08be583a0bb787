"""Report rows: SARIF results, SPDX packages and CycloneDX components as JSON text per row, written by ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.supply_chain import purl


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("Critical", "High"), "error").when(severity == "Medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """``ord, rule, level, result``: one SARIF result object per finding."""
    level = sarif_level(F.col("severity"))
    result = F.to_json(F.struct(F.col("vtype").alias("ruleId"), level.alias("level"), F.struct(F.col("evidence").alias("text")).alias("message"), F.struct(F.col("file").alias("uri")).alias("location")))
    return findings.select("ord", F.col("vtype").alias("rule"), level.alias("level"), result.alias("result"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules with the level of their first finding."""
    return findings.groupBy(F.col("vtype").alias("rule")).agg(F.min_by(sarif_level(F.col("severity")), "ord").alias("level"), F.count("*").alias("results"))


def spdx_packages(deps: DataFrame) -> DataFrame:
    """``number, package``: packages in name order, numbered inside groups of one initial and shifted by the groups before.

    There is a group per ecosystem and first character, so no task holds all packages.
    """
    initial = F.coalesce(F.left("name", F.lit(1)), F.lit(""))
    rows = deps.withColumn("_initial", initial).withColumn("_ecosystem", F.coalesce("ecosystem", F.lit("")))
    key = ["_ecosystem", "_initial"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))  # at most a row per ecosystem and character
    shift = sizes.select(*key, F.coalesce(F.sum("_n").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    number = (F.row_number().over(Window.partitionBy(*key).orderBy("name", "version_spec")) + F.col("_shift")).cast("int")
    deps = rows.join(shift, key)
    body = F.to_json(F.struct(F.concat(F.lit("SPDXRef-Package-"), F.col("number").cast("string")).alias("SPDXID"), "name", F.coalesce("version_spec", F.lit("NOASSERTION")).alias("versionInfo")))
    return deps.withColumn("number", number).select("number", body.alias("package"))


def cyclonedx_components(deps: DataFrame) -> DataFrame:
    """``name, component``: one CycloneDX library per dependency."""
    body = F.to_json(F.struct(F.lit("library").alias("type"), "name", F.col("version_spec").alias("version"), purl(F.col("ecosystem"), F.col("name"), F.col("version_spec")).alias("purl")))
    return deps.select("name", body.alias("component"))


def markdown_summary(findings: DataFrame) -> DataFrame:
    """``severity, line``: a table row per severity and type, for a text report."""
    counted = findings.groupBy("severity", "sev_rank", "vtype").agg(F.count("*").alias("n"))
    return counted.select("severity", "sev_rank", F.format_string("| %s | %s | %d |", "severity", "vtype", "n").alias("line"))
