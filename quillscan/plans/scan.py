"""The scan as one declarative plan: detectors over ``files``, then policy, correlation, deduplication and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.license import families_in_text, family, licence_of_text
from ..functions.text import bound, occurrences
from ..operators.data_rights import geodata_of, has_email, has_ipv4, secrets_of
from ..operators.findings import Policy, apply_policy, correlate, deduplicate, type_rows
from ..refdata import ML_DATASETS

_DEFAULTS = {name: (severity, rank) for name, _, severity, rank in type_rows()}


#: Findings of one file that ``ord`` can tell apart from those of the next.
_STEP = 1_000_000


def _finding(phase: str, vtype: str | Column, confidence: float, evidence: Column) -> Column:
    """A struct of one detector's finding."""
    kind = F.lit(vtype) if isinstance(vtype, str) else vtype
    return F.struct(F.lit(phase).alias("phase"), kind.alias("vtype"), F.lit(confidence).alias("confidence"), evidence.cast("string").alias("evidence"))


def detect(files: DataFrame) -> DataFrame:
    """Findings of all detectors over ``ord, path, text``: one scan, each text lower-cased and normalised once.

    A file gives a finding per licence, mixture, kind of personal data, data set, map provider and secret of a line; a null
    text counts as empty. ``ord`` numbers a file's findings from ``ord * 1,000,000``.
    """
    text = F.coalesce("text", F.lit(""))
    base = files.select("ord", "path", text.alias("text"), F.lower(text).alias("low"), licence_of_text(text).alias("licence"), families_in_text(text).alias("families"))
    low, licence, families = F.col("low"), F.col("licence"), F.col("families")
    by_family = bound(family(licence), lambda fam: F.when(fam.isin("StrongCopyleft", "NetworkCopyleft"), "CopyleftInProprietary").when(fam == "CreativeCommonsRestricted", "CcNonCommercialViolation").when(fam == "SourceAvailable", "CommercialUseViolation"))
    text = F.col("text")
    datasets = F.array_compact(F.array(*(F.when(low.contains(n), F.lit(n)) for n, _ in ML_DATASETS)))
    once = lambda *pairs: F.array_compact(F.array(*(F.when(when, finding) for when, finding in pairs)))
    found = F.concat(
        once(
            (licence.isNotNull(), _finding("license_text", by_family, 0.9, licence)),
            (F.size(families) >= 3, _finding("license_text", "ChimeraLicense", 0.85, F.array_join(families, ","))),
            (has_email(text), _finding("data_rights", "PiiExposure", 0.8, F.lit("email"))),
            (has_ipv4(text), _finding("data_rights", "PiiExposure", 0.7, F.lit("ip"))),
        ),
        F.transform(datasets, lambda d: _finding("data_rights", "MlDatasetViolation", 0.75, d)),
        F.transform(geodata_of(low), lambda g: _finding("data_rights", "UnlicensedGeodata", 0.8, g["provider"])),
        F.transform(secrets_of(text), lambda s: _finding("data_rights", "ExposedSecrets", 0.9, F.concat(s["secret"], F.lit(" line "), s["line_no"].cast("string"), F.lit(": "), s["redacted"]))),
        once((low.contains("all rights reserved"), _finding("attribution", "MissingAttribution", 0.5, occurrences(low, "all rights reserved")))),
    )
    hits = base.select("ord", "path", F.posexplode(found).alias("n", "f")).filter("f.vtype IS NOT NULL")
    looked_up = lambda k: F.element_at(F.create_map(*(F.lit(x) for name, v in _DEFAULTS.items() for x in (name, v[k]))), F.col("f.vtype"))
    return hits.select((F.col("ord") * _STEP + F.col("n")).alias("ord"), "f.phase", "f.vtype", F.col("path").alias("file"), looked_up(0).alias("severity"), looked_up(1).alias("sev_rank"), "f.confidence", "f.evidence")


def scan(files: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Findings after policy, correlation and deduplication."""
    return deduplicate(correlate(apply_policy(detect(files), policy or Policy())).drop("corroborated"))
