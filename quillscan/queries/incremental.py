"""A second scan of the documents after some changed, some went and one came: what it scans again, and what it finds in all."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..catalog import _DETECTED, _DOCS, _files, query
from ..plans.incremental import incremental_scan
from ..storage import shared

#: What was there at the first scan, and what is there at the second.
_BEFORE = "doc_id % 13 <> 4"
_AFTER = "doc_id % 11 <> 3"
_ADDED = "CASE WHEN doc_id % 7 = 0 THEN ' mail new.person@example.com all rights reserved' ELSE '' END"
_PATH = "'documents/' || CAST(doc_id AS VARCHAR) || '.txt'"
_NEEDS = 17


def _rerun(spark, sf_dir):
    cache = f"{shared(spark)}/scan-cache-{uuid.uuid4().hex}"
    docs = _files(spark, sf_dir)
    by = F.col("ord")
    before = docs.filter(by % 13 != 4)
    after = docs.filter(by % 11 != 3).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.expr(_ADDED.replace("doc_id", "ord"))))
    # every 17th document needs the one before it
    needs = docs.filter(by % _NEEDS == 1).select("path", F.format_string("documents/%d.txt", by - 1).alias("needs"))
    incremental_scan(before, cache)
    return incremental_scan(after, cache, needs=needs)


@query(
    f"""WITH b AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents WHERE {_BEFORE}), a AS (SELECT doc_id, sha256(coalesce(text, '') || {_ADDED}) AS sha FROM documents WHERE {_AFTER}),
    s AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.sha, b.sha) AS sha256, CASE WHEN a.doc_id IS NULL THEN 'removed' WHEN b.doc_id IS NULL THEN 'new' WHEN a.sha <> b.sha THEN 'changed' ELSE 'hit' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id)
    SELECT {_PATH} AS path, sha256, CASE WHEN state = 'hit' AND doc_id % {_NEEDS} = 1 AND (doc_id - 1) IN (SELECT doc_id FROM s WHERE state <> 'hit') THEN 'depends' ELSE state END AS state FROM s"""
)
def rescanned_files(spark, sf_dir):
    """What became of every file between two scans."""
    return _rerun(spark, sf_dir).states


@query(f"WITH after_ AS (SELECT doc_id, coalesce(text, '') || {_ADDED} AS text FROM documents WHERE {_AFTER}), {_DETECTED.replace(_DOCS, _DOCS.replace('FROM documents', 'FROM after_'))} SELECT ord, phase, vtype, file, severity, sev_rank, confidence, evidence FROM found")
def rescan_findings(spark, sf_dir):
    """Findings after the second scan, most of them from the first: those of a whole scan."""
    return _rerun(spark, sf_dir).findings
