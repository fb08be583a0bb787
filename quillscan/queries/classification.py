"""Licences of documents by ids, phrases and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import _docs, _q, _values, query
from ..operators import classification as C
from ..refdata_licences import LICENCES

_MARK = "|".join(m.replace("*", r"\*") for m in C.MARKS)
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_HAS = ", ".join("(" + " AND ".join("(" + " OR ".join(f"contains(low, {_q(t)})" for t in lists) + ")" for lists in C.CLAUSES[c]) + f") AS has_{c.replace(' ', '_')}" for c in C.CLAUSES)
_FITS = " ".join("WHEN " + " AND ".join([*(f"has_{c.replace(' ', '_')}" for c in must), *(f"NOT has_{c.replace(' ', '_')}" for c in mustnt)]) + f" THEN {k}" for k, (must, mustnt, _, _) in enumerate(C.BY_CLAUSES))


def classify_sql(source: str) -> str:
    """CTEs after one named ``source`` with a column ``text``: ``candidate`` (text, place, licence, confidence, method, rank) of its distinct texts."""
    return f"""src AS MATERIALIZED (SELECT DISTINCT text FROM {source} WHERE text IS NOT NULL), low_ AS (SELECT text, lower(text) AS low FROM src), claus AS (SELECT text, {_HAS} FROM low_),
    tag AS (SELECT text, list_filter(list_transform(string_split(text, chr(10))[1:{C.DIRECTIVE_LINES}], lambda l: trim(regexp_replace(trim(regexp_extract(trim(l, {_BLANK}), '^(?:{_MARK})?SPDX-License-Identifier:(.*)$', 1), {_BLANK}), '(?:\\*/)+$', ''), {_BLANK})), lambda x: x <> '')[1] AS id FROM src),
    ids(low, id) AS ({_values([(i.lower(), i) for i in C.IDS])}), phrases(p, licence, total, place) AS ({_values([(p, lic, n, [r[0] for r in LICENCES].index(lic) + 1) for p, (lic, n) in C.PHRASES.items()])}),
    id_hits AS (SELECT text, lower(h) AS low, k FROM (SELECT text, unnest(regexp_extract_all(text, {_q(C.earliest(C.IDS))})) AS h, generate_subscripts(regexp_extract_all(text, {_q(C.earliest(C.IDS))}), 1) AS k FROM src WHERE text NOT IN (SELECT text FROM tag WHERE id IS NOT NULL))),
    by_id AS (SELECT text, ids.id, n FROM (SELECT text, low, count(*) AS n, min(k) AS at_ FROM id_hits GROUP BY text, low QUALIFY row_number() OVER (PARTITION BY text ORDER BY count(*) DESC, min(k)) = 1) JOIN ids USING (low)),
    by_phrase AS (SELECT text, licence, place, count(*) AS n, any_value(total) AS total FROM (SELECT text, lower(unnest(regexp_extract_all(text, {_q(C.earliest(list(C.PHRASES)))}))) AS p FROM src) JOIN phrases USING (p) GROUP BY text, licence, place),
    cl(k, licence, confidence) AS ({_values([(k, lic, float(c)) for k, (_, _, lic, c) in enumerate(C.BY_CLAUSES)])}),
    candidate AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY text ORDER BY confidence DESC, place) AS rank FROM (
      SELECT text, 0 AS place, id AS licence, CAST({C.DIRECTIVE} AS DOUBLE) AS confidence, 'SpdxIdentifier' AS method FROM tag WHERE id IS NOT NULL
      UNION ALL SELECT text, 0, id, least({C.ID_MOST}, CAST({C.ID_BASE} AS DOUBLE) + n * CAST({C.ID_STEP} AS DOUBLE)), 'SpdxIdentifier' FROM by_id
      UNION ALL SELECT text, place, licence, least({C.PHRASE_MOST}, CAST({C.PHRASE_BASE} AS DOUBLE) + n / total::DOUBLE * CAST({C.PHRASE_SHARE} AS DOUBLE)), 'HeaderPattern' FROM by_phrase
      UNION ALL SELECT text, {len(LICENCES) + 1}, licence, confidence, 'StructuralAnalysis' FROM (SELECT text, CASE {_FITS} END AS k FROM claus) JOIN cl USING (k)))"""


@query(f"WITH {classify_sql('documents')} SELECT doc_id, licence, round(confidence, 6) AS confidence, method, CAST((SELECT count(*) FROM candidate o WHERE o.text = d.text) - 1 AS INTEGER) AS alternatives FROM documents d JOIN candidate c USING (text) WHERE rank = 1")
def document_licences(spark, sf_dir):
    """The surest licence of every document that hints at one, and how many others it hints at."""
    found = _docs(spark, sf_dir).select("doc_id", C.classified(F.col("text")).alias("c")).filter("c IS NOT NULL")
    return found.select("doc_id", "c.licence", F.round("c.confidence", 6).alias("confidence"), "c.method", F.size("c.alternatives").alias("alternatives"))


@query(f"WITH {classify_sql('documents')} SELECT doc_id, licence, round(confidence, 6) AS confidence, CAST(rank AS INTEGER) - 1 AS place FROM documents JOIN candidate USING (text) WHERE rank > 1")
def document_licence_alternatives(spark, sf_dir):
    """What else documents may be under, the surest first."""
    found = _docs(spark, sf_dir).select("doc_id", F.posexplode(C.classified(F.col("text"))["alternatives"]).alias("k", "a"))
    return found.select("doc_id", "a.licence", F.round("a.confidence", 6).alias("confidence"), (F.col("k") + 1).alias("place"))
