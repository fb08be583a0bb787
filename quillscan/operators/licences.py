"""The licence table: look-up, obligations, classification of texts and manifests, checks of dependency lists."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.license import compatibility, family
from ..refdata_licences import LICENCES

_SCHEMA = "id string, name string, family string, obligations array<string>, osi_approved boolean, fsf_free boolean, proprietary_compatible boolean, spellings array<string>, file_names array<string>, header_phrases array<string>"


def licence_table(spark: SparkSession) -> DataFrame:
    """All known licences (a fixed number of rows)."""
    return spark.createDataFrame(LICENCES, _SCHEMA)


def lookup(rows: DataFrame, licence: str = "licence") -> DataFrame:
    """``rows`` with the struct ``known`` of the licence of that id in any case, null if there is none."""
    table = licence_table(rows.sparkSession)
    known = table.select(F.upper("id").alias("_key"), F.struct(*table.columns).alias("known"))
    return rows.withColumn("_key", F.upper(licence)).join(F.broadcast(known), "_key", "left").drop("_key")


def by_family(spark: SparkSession, name: str) -> DataFrame:
    return licence_table(spark).filter(F.col("family") == name)


def obligations(rows: DataFrame, licence: str = "licence") -> DataFrame:
    """``rows`` with ``obligations`` of the licence, empty for an unknown one."""
    return lookup(rows, licence).withColumn("obligations", F.coalesce("known.obligations", F.array().cast("array<string>"))).drop("known")


def header_matches(text: Column, least: int = 2) -> Column:
    """Array of (id, matched, confidence) of licences of whose header phrases at least ``least``, or all, stand in the text."""
    low = F.lower(text)

    def one(row: tuple) -> Column:
        phrases = row[9]
        n = reduce(lambda a, b: a + b, (low.contains(p.lower()).cast("int") for p in phrases))
        return F.when(n >= min(least, len(phrases)), F.struct(F.lit(row[0]).alias("id"), n.alias("matched"), (n / F.lit(len(phrases))).alias("confidence")))

    return F.array_compact(F.array(*(one(row) for row in LICENCES if row[9])))


def spelled(declared: Column) -> Column:
    """Id of the licence that a manifest's declaration spells, in any case; null if none."""
    up = F.upper(F.trim(declared))
    return F.coalesce(*(F.when(up.isin([s.upper() for s in row[7]]), F.lit(row[0])) for row in LICENCES))


def incompatible_dependencies(deps: DataFrame, project: str, commercial: bool = False, network: bool = False, static_linking: bool = False) -> DataFrame:
    """Rows of ``name, licence`` whose licence does not fit the project's; also checks a whole tree's list."""
    rule = compatibility(F.col("licence"), F.lit(project), F.lit(commercial), F.lit(network), F.lit(static_linking))
    return deps.filter(rule == "Incompatible").select("name", "licence", F.lit(project).alias("project"), F.lit("Critical").alias("severity"))


def conflicting_licences(deps: DataFrame) -> DataFrame:
    """``a, b``: pairs of different licences in a list that do not go together, each pair once.

    Only distinct licences are paired, so the join's size does not follow the list's.
    """
    ids = deps.select("licence").filter("licence IS NOT NULL").distinct()
    no = F.lit(False)
    pairs = ids.select(F.col("licence").alias("a")).join(ids.select(F.col("licence").alias("b")), F.col("a") < F.col("b"))
    return pairs.filter((compatibility(F.col("a"), F.col("b"), no, no, no) == "Incompatible") & (compatibility(F.col("b"), F.col("a"), no, no, no) == "Incompatible"))


# ---------------------------------------------------------------- policy on licences


@dataclass
class LicencePolicy:
    """Licences that a project refuses or, if any are named, alone accepts; exceptions by dependency; the greatest score."""

    allowed: list[str] = field(default_factory=list)
    blocked: list[str] = field(default_factory=list)
    #: Dependencies that are not looked at.
    ignored: list[str] = field(default_factory=list)
    ignored_violations: list[str] = field(default_factory=list)
    ignore_paths: list[str] = field(default_factory=lambda: ["vendor/", "third_party/", "node_modules/"])
    min_severity: str = "low"
    max_risk_score: int = 100
    commercial: bool = True
    network_service: bool = False


def policy_from_toml(text: str | None) -> LicencePolicy:
    """A project's policy file; without one, or with one that cannot be read, the default."""
    import tomllib

    if text is None:
        return LicencePolicy()
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return LicencePolicy()
    names = {"allowed_licenses": "allowed", "blocked_licenses": "blocked"}
    known = {names.get(k, k): v for k, v in found.items() if names.get(k, k) in LicencePolicy.__dataclass_fields__}
    return LicencePolicy(**known | {"ignored": [o["name"] for o in found.get("overrides", []) if o.get("ignore")]})


def severity_rank(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low == "critical", 4).when(low == "high", 3).when(low.isin("medium", "med"), 2).otherwise(1)


def is_blocked(licence: Column, policy: LicencePolicy) -> Column:
    return F.upper(licence).isin([x.upper() for x in policy.blocked]) if policy.blocked else F.lit(False)


def is_allowed(licence: Column, policy: LicencePolicy) -> Column:
    return F.upper(licence).isin([x.upper() for x in policy.allowed]) if policy.allowed else F.lit(True)


def policy_findings(deps: DataFrame, policy: LicencePolicy) -> DataFrame:
    """``name, licence, rule, severity`` of dependencies whose licence is blocked or, where only some are allowed, is not one of them."""
    seen = deps.filter(~F.col("name").isin(policy.ignored)) if policy.ignored else deps
    licence = F.col("licence")
    rules = F.array_compact(
        F.array(F.when(is_blocked(licence, policy), F.struct(F.lit("blocked").alias("rule"), F.lit("Critical").alias("severity"))), F.when(~is_allowed(licence, policy), F.struct(F.lit("unapproved").alias("rule"), F.lit("High").alias("severity"))))
    )
    return seen.filter(licence.isNotNull()).select("name", "licence", F.explode(rules).alias("_r")).select("name", "licence", "_r.rule", "_r.severity")


def exceeds_threshold(score: Column, policy: LicencePolicy) -> Column:
    return score > policy.max_risk_score


def families_of(deps: DataFrame) -> DataFrame:
    return deps.withColumn("family", family(F.col("licence")))
