"""Selections of indexed files (``path, ext, category, size``) and of findings, and risk tables of data rights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..refdata import FINDING_TYPES
from ..sources.files import file_name

# Extensions whose texts are fingerprinted, and those looked at for where they come from.
FINGERPRINTED = ["rs", "py", "js", "ts", "c", "cpp", "h", "go", "java", "rb"]
TRACED = ["rs", "go", "ts", "java", "py", "c", "cpp", "h", "rb"]
# Kinds of personal data: kind, risk, points, regulations.
PII_RISKS = [
    ("Email", "Medium", 10, ["GDPR Art. 4(1) — personal data", "CCPA §1798.140(o) — personal information"]),
    ("PhoneNumber", "Medium", 10, ["GDPR Art. 4(1)", "TCPA — telephone consumer protection"]),
    ("SocialSecurityNumber", "Critical", 25, ["GDPR Art. 9 — special categories", "CCPA §1798.140(o) — sensitive personal information", "HIPAA — if health-related"]),
    ("Passport", "High", 20, ["GDPR Art. 9 — special categories", "CCPA §1798.140(o) — sensitive personal information", "HIPAA — if health-related"]),
    ("DriverLicense", "High", 20, ["GDPR Art. 9 — special categories", "CCPA §1798.140(o) — sensitive personal information", "HIPAA — if health-related"]),
    ("IpAddress", "Low", 5, ["GDPR Art. 4(1) — IP addresses are personal data (CJEU ruling)"]),
    ("CreditCardNumber", "Critical", 25, ["PCI DSS — payment card data", "GDPR Art. 4(1)"]),
    ("MedicalRecord", "Critical", 25, ["GDPR Art. 9 — special categories of data", "HIPAA — health information", "BIPA — biometric data (Illinois)"]),
    ("BiometricData", "Critical", 25, ["GDPR Art. 9 — special categories of data", "HIPAA — health information", "BIPA — biometric data (Illinois)"]),
    ("DateOfBirth", "Medium", 5, ["GDPR Art. 4(1)", "CCPA §1798.140(o)"]),
    ("Name", "Medium", 5, ["GDPR Art. 4(1)", "CCPA §1798.140(o)"]),
    ("Address", "Medium", 5, ["GDPR Art. 4(1)", "CCPA §1798.140(o)"]),
    ("GpsCoordinates", "Low", 5, ["GDPR Art. 4(1)", "CCPA §1798.140(o)"]),
    ("DeviceIdentifier", "Low", 5, ["GDPR Art. 4(1)", "CCPA §1798.140(o)"]),
]
RISK_ORDER = ["None", "Low", "Medium", "High", "Critical"]
# What data licences ask for.
DATA_DUTIES = [
    ("ODbL-1.0", ["Attribution required", "Share-alike: derivatives must be ODbL", "Keep open: API access must not restrict"]),
    ("CDLA-Permissive-2.0", ["Attribution required", "No copyleft on enhanced data"]),
    ("CDLA-Sharing-1.0", ["Attribution required", "Share-alike: enhanced data must be CDLA-Sharing"]),
    ("DbCL-1.0", ["No restrictions on individual contents", "Database structure may have separate protection"]),
    ("ODC-By-1.0", ["Attribution required", "No share-alike requirement"]),
    ("PDDL-1.0", ["No restrictions — public domain"]),
    ("OGL-UK-3.0", ["Attribution to Crown copyright", "No restrictions on commercial use"]),
]


def of_category(files: DataFrame, *names: str) -> DataFrame:
    return files.filter(F.col("category").isin(list(names)))


def of_extensions(files: DataFrame, *extensions: str) -> DataFrame:
    return files.filter(F.col("ext").isin([e.lower() for e in extensions]))


def source_code(files: DataFrame) -> DataFrame:
    return of_category(files, "SourceCode", "JavaScript", "TypeScript")


def scripts(files: DataFrame) -> DataFrame:
    return of_category(files, "JavaScript", "TypeScript")


def large_scripts(files: DataFrame, least: int = 50_000) -> DataFrame:
    return of_category(files, "JavaScript").filter(F.col("size") >= least)


def fingerprintable(files: DataFrame) -> DataFrame:
    return of_extensions(source_code(files), *FINGERPRINTED).filter("size > 200")


def provenance_candidates(files: DataFrame) -> DataFrame:
    return of_extensions(source_code(files), *TRACED).filter("size > 500")


def script_candidates(files: DataFrame) -> DataFrame:
    return scripts(files).filter("size > 2000")


def licence_files(files: DataFrame) -> DataFrame:
    """Files named after a licence or notice, at most three parts deep."""
    name = F.upper(file_name(F.col("path")))
    named = name.contains("LICENSE") | name.contains("LICENCE") | name.contains("COPYING") | name.contains("NOTICE")
    return files.filter(named & (F.size(F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")) <= 3))


def uses_of(files: DataFrame) -> DataFrame:
    """``path`` with one flag per selection, in one pass."""
    code, js = F.col("category").isin("SourceCode", "JavaScript", "TypeScript"), F.col("category").isin("JavaScript", "TypeScript")
    return files.select(
        "path", code.alias("source_code"), (code & F.col("ext").isin(FINGERPRINTED) & (F.col("size") > 200)).alias("fingerprintable"), (code & F.col("ext").isin(TRACED) & (F.col("size") > 500)).alias("traceable"),
        (js & (F.col("size") > 2000)).alias("script_candidate"), ((F.col("category") == "JavaScript") & (F.col("size") >= 50_000)).alias("large_script"),
    )


# ---------------------------------------------------------------- findings


def by_category(findings: DataFrame, category: str) -> DataFrame:
    return findings.filter(F.col("vtype").isin([n for n, c, _ in FINDING_TYPES if c == category]))


def kinds(findings: DataFrame) -> DataFrame:
    """Distinct types of findings, each once."""
    return findings.select("vtype").distinct()


def has_critical(findings: DataFrame) -> DataFrame:
    """One row ``has_critical``."""
    return findings.agg(F.coalesce(F.bool_or(F.col("severity") == "Critical"), F.lit(False)).alias("has_critical"))


# ---------------------------------------------------------------- data rights


def _by_kind(kind: Column, place: int, otherwise: Column) -> Column:
    return F.coalesce(*(F.when(kind == r[0], F.lit(r[place]) if place < 3 else F.array(*map(F.lit, r[place]))) for r in PII_RISKS), otherwise)


def pii_risk(kind: Column) -> Column:
    return _by_kind(kind, 1, F.lit("None"))


def regulations(kind: Column) -> Column:
    return _by_kind(kind, 3, F.array(F.lit("GDPR Art. 4(1)"), F.lit("CCPA §1798.140(o)")))


def greater_risk(a: Column, b: Column) -> Column:
    order = F.array(*map(F.lit, RISK_ORDER))
    return F.when(F.array_position(order, a) >= F.array_position(order, b), a).otherwise(b)


def data_duties(licence: Column) -> Column:
    return F.coalesce(*(F.when(licence == n, F.array(*map(F.lit, d))) for n, d in DATA_DUTIES), F.array().cast("array<string>"))


def data_rights_risk(kinds_: DataFrame, secrets: DataFrame, unlicensed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``risk``, one row or one for each value of the columns ``by``: points by kind of personal data, 15 a secret, 3 an unlicensed data file; at most 100."""
    by = by or []
    points = kinds_.select(*by, _by_kind(F.col("kind"), 2, F.lit(5)).alias("p")).unionByName(secrets.select(*by, F.lit(15).alias("p"))).unionByName(unlicensed.select(*by, F.lit(3).alias("p")))
    return points.groupBy(*by).agg(F.least(F.lit(100), F.coalesce(F.sum("p"), F.lit(0))).cast("int").alias("risk"))
