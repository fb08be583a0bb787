"""Licence headers of source files: SPDX directives, copyrights, generated files, missing and mismatched headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.license import family, licence_of_text
from ..functions.text import lines

# Marks of generated files.
GENERATED = [
    r"(?i)(auto[- ]?generated|do not edit|machine generated)", r"(?i)generated by (protoc|protobuf|thrift|swagger|openapi|antlr|flex|bison|yacc)", r"(?i)@generated", r"(?i)THIS FILE IS GENERATED", r"(?i)Code generated by.*DO NOT EDIT",
]
REGION = 100


def region(text: Column, n: int = REGION) -> Column:
    """The first ``n`` lines."""
    return F.slice(lines(text), 1, n)


def spdx_ids(text: Column) -> Column:
    """Ids of all SPDX directives in the header region."""
    found = F.transform(region(text), lambda x: F.regexp_extract(x, r"SPDX-License-Identifier:\s*([A-Za-z0-9.+()\- ]*[A-Za-z0-9.+)])", 1))
    return F.filter(found, lambda x: x != "")


def is_generated(text: Column) -> Column:
    head = F.array_join(region(text, 20), "\n")
    return F.exists(F.array(*(F.lit(p) for p in GENERATED)), lambda p: F.regexp_like(head, p))


def copyrights(text: Column) -> Column:
    """Structs ``years, holder`` of copyright lines in the header region."""
    pattern = r"(?i)(?:copyright|\(c\)|©)[\s(c)©]*((?:19|20)\d{2}(?:\s*[-,]\s*(?:19|20)?\d{2,4})*)[\s,]+(?:by\s+)?([^.<\n]+)"
    hits = F.filter(region(text), lambda x: x.rlike(pattern))
    return F.transform(hits, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("years"), F.trim(F.regexp_extract(x, pattern, 2)).alias("holder")))


def headers(files: DataFrame) -> DataFrame:
    """``path, licence, family, confidence, generated``: the first SPDX id, else what the region's text says."""
    first = F.try_element_at(spdx_ids(F.col("text")), F.lit(1))
    plain = licence_of_text(F.array_join(region(F.col("text")), "\n"))
    found = files.select("path", first.alias("_s"), plain.alias("_p"), is_generated(F.col("text")).alias("generated"))
    licence = F.coalesce("_s", "_p")
    return found.select("path", licence.alias("licence"), F.when(F.col("_s").isNotNull(), 0.99).when(F.col("_p").isNotNull(), 0.8).alias("confidence"), "generated").withColumn("family", family(F.col("licence")))


def header_findings(files: DataFrame, project_licence: str) -> DataFrame:
    """``path, vtype``: no header in a file that is not generated, or a header of another family than the project's."""
    found = headers(files).withColumn("_own", family(F.lit(project_licence)))
    kind = F.when(F.col("licence").isNull(), F.when(~F.col("generated"), F.lit("MissingSpdxHeader"))).when((F.col("family") != F.col("_own")) & (F.col("confidence") > 0.7) & ~F.col("generated") & ~F.upper("licence").contains(" OR "), F.lit("ManifestLicenseMismatch"))
    return found.select("path", kind.alias("vtype")).filter("vtype IS NOT NULL")
