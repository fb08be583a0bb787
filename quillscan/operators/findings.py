"""Operators over findings: dimension tables, policy, correlation, deduplication, scores, evidence.

A finding has ``ord, phase, vtype, file, severity, sev_rank, confidence, evidence``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..refdata import COMMERCIAL_MULTIPLIER, CORRELATED, FINDING_TYPES, MULTIPLIERS, NETWORK_MULTIPLIER, SEVERITIES

FINDING = "ord long, phase string, vtype string, file string, severity string, sev_rank int, confidence double, evidence string"


@dataclass
class Policy:
    """What to report."""

    min_severity: int = 1
    ignored_types: list[str] = field(default_factory=list)
    ignored_paths: list[str] = field(default_factory=list)
    commercial: bool = False
    network_service: bool = False


_RANKS = {name: rank for name, rank, _ in SEVERITIES}


def type_rows() -> list[tuple[str, str, str, int]]:
    return [(name, category, severity, _RANKS[severity]) for name, category, severity in FINDING_TYPES]


def finding_types(spark: SparkSession) -> DataFrame:
    """The dimension table: ``vtype, category, severity, sev_rank`` (a fixed number of rows)."""
    return spark.createDataFrame(type_rows(), "vtype string, category string, severity string, sev_rank int")


def base_score(sev_rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(score) for _, _, score in SEVERITIES)), sev_rank)


def multiplier_rows(policy: Policy) -> list[tuple[str, float]]:
    table = dict(MULTIPLIERS)
    if policy.network_service:
        table |= NETWORK_MULTIPLIER
    if policy.commercial:
        table |= COMMERCIAL_MULTIPLIER
    return sorted(table.items())


def apply_policy(findings: DataFrame, policy: Policy) -> DataFrame:
    """Findings of at least the wanted severity, of no ignored type and in no ignored path."""
    kept = findings.filter(F.col("sev_rank") >= policy.min_severity)
    if policy.ignored_types:
        kept = kept.filter(~F.col("vtype").isin(policy.ignored_types))
    for part in policy.ignored_paths:
        kept = kept.filter(~F.replace(F.col("file"), F.lit("\\"), F.lit("/")).contains(part))
    return kept


def correlation_rows() -> list[tuple[str, str]]:
    return sorted({*CORRELATED, *((b, a) for a, b in CORRELATED)})


def correlate(findings: DataFrame) -> DataFrame:
    """Findings that another finding in the same file corroborates get 1.3 times the confidence and, from Medium up, one more severity.

    The set of a file's types decides, so each finding only needs that set, which has a
    fixed greatest size; findings are read once and dealt out by file once.
    """
    partners: dict[str, list[str]] = {}
    for a, b in correlation_rows():
        partners.setdefault(a, []).append(b)
    table = F.create_map(*(x for a, bs in partners.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))))
    present = F.collect_set("vtype").over(Window.partitionBy("file"))
    marked = findings.withColumn("corroborated", F.coalesce(F.arrays_overlap(F.element_at(table, F.col("vtype")), present), F.lit(False)))
    up = F.col("corroborated")
    rank = F.when(up & F.col("sev_rank").isin(2, 3), F.col("sev_rank") + 1).otherwise(F.col("sev_rank"))
    names = F.array(*(F.lit(n) for n in ("Low", "Medium", "High", "Critical")))
    return marked.select(
        "ord", "phase", "vtype", "file", F.element_at(names, rank).alias("severity"), rank.alias("sev_rank"), F.when(up, F.least(F.lit(1.0), F.col("confidence") * 1.3)).otherwise(F.col("confidence")).alias("confidence"), "evidence", "corroborated"
    )


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding per (file, type): the first row's fields, the greatest confidence and severity, all evidence in order."""
    names = F.array(*(F.lit(n) for n in ("Low", "Medium", "High", "Critical")))
    pieces = F.array_sort(F.collect_list(F.when(F.col("evidence").isNotNull(), F.struct("ord", "evidence"))))
    grouped = findings.groupBy("file", "vtype").agg(F.min("ord").alias("ord"), F.min_by("phase", "ord").alias("phase"), F.max("sev_rank").alias("sev_rank"), F.max("confidence").alias("confidence"), pieces.alias("_e"), F.count("*").alias("merged"))
    return grouped.select("ord", "phase", "vtype", "file", F.element_at(names, F.col("sev_rank")).alias("severity"), "sev_rank", "confidence", F.array_join(F.transform("_e", lambda e: e["evidence"]), "; ").alias("evidence"), "merged")


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: total and the count of each severity."""
    return findings.agg(F.count("*").alias("total"), *(F.count_if(F.col("sev_rank") == r).alias(n) for n, r in (("low", 1), ("medium", 2), ("high", 3), ("critical", 4))))


def risk_level(score: Column) -> Column:
    return F.when(score == 0, "Clean").when(score <= 20, "Low").when(score <= 50, "Medium").when(score <= 80, "High").otherwise("Critical")


def risk_score(findings: DataFrame, policy: Policy | None = None) -> DataFrame:
    """One row ``score, level``: whole points per finding (base times multiplier times confidence), at most 100."""
    spark = findings.sparkSession
    weights = spark.createDataFrame(multiplier_rows(policy or Policy()), "vtype string, multiplier double")
    points = (base_score(F.col("sev_rank")) * F.coalesce("multiplier", F.lit(1.0)) * F.col("confidence")).cast("int")
    # custom findings about DRM weigh as much as a laundered licence
    weighed = findings.join(F.broadcast(weights), "vtype", "left").withColumn("multiplier", F.when(F.col("vtype").startswith("Custom") & F.col("vtype").contains("DRM"), F.lit(2.0)).otherwise(F.col("multiplier")))
    scored = weighed.select(points.alias("p"))
    score = F.least(F.lit(100), F.coalesce(F.sum("p"), F.lit(0))).cast("int")
    return scored.agg(score.alias("score")).withColumn("level", risk_level(F.col("score")))


def evidence_chain(findings: DataFrame, thesis: str, stamp: str) -> DataFrame:
    """One row per file: a hash over the thesis, each finding's evidence hash in order, and the given time stamp."""
    item = F.sha2(F.concat_ws("|", "vtype", "file", F.coalesce("evidence", F.lit(""))), 256)
    ordered = F.array_sort(F.collect_list(F.struct("ord", item.alias("h"))))
    return findings.groupBy("file").agg(ordered.alias("items")).select("file", F.size("items").alias("items"), F.sha2(F.concat_ws("|", F.lit(thesis), F.array_join(F.transform("items", lambda i: i["h"]), "|"), F.lit(stamp)), 256).alias("chain_hash"))
