"""Queries over the reference's operators on the driver's tables, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import refdata as R
from .functions import text as T
from .functions.license import compatibility, families_in_text, family, is_copyleft, is_permissive, licence_of_text
from .functions.spdx import spdx
from .operators import code, contamination, data_rights, findings, headers, structure, supply_chain
from .plans import reports
from .plans.comparison import compare
from .plans.scan import detect, scan
from .sources.files import category, documents_as_files, input_kind, package_spec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(_docs(spark, sf_dir))


# ---------------------------------------------------------------- SQL pieces, built from the same fixed values


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r) + ")" for r in rows)


def dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], *names: str) -> DataFrame:
    """``part`` and the fields ``names``: the fixed rows dealt to the rows of the part table by their keys."""
    kinds = [next((type(r[k]) for r in rows if r[k] is not None), str) for k in range(len(names))]
    types = {str: "string", int: "int", float: "double", bool: "boolean"}
    fixed = F.array(*(F.struct(*(F.lit(v).cast(types[t]).alias(n) for v, t, n in zip(r, kinds, names, strict=True))) for r in rows))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey IS NOT NULL")
    return parts.select(F.col("p_partkey").alias("part"), F.element_at(fixed, (F.pmod("p_partkey", F.lit(len(rows))) + 1).cast("int")).alias("_r")).select("part", "_r.*")


def dealt_sql(rows: list[tuple], *names: str) -> str:
    """The same rows as a table in SQL."""
    return f"(SELECT p_partkey AS part, {', '.join(names)} FROM part JOIN ({_values([(k, *r) for k, r in enumerate(rows)])}) v(_k, {', '.join(names)}) ON _k = p_partkey % {len(rows)})"


def _plain_sql(text: str) -> str:
    t = f"translate({text}, {_q(''.join(R.LOOKALIKES) + ''.join(R.SPACES))}, {_q(''.join(R.LOOKALIKES.values()) + ' ' * len(R.SPACES))})"
    for c in R.DROPPED:
        t = f"replace({t}, {_q(c)}, '')"
    return rf"trim(regexp_replace(lower({t}), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


def _licence_sql(plain: str) -> str:
    arms = []
    for name, all_, any_ in R.LICENSE_PHRASES:
        tests = [f"contains({plain}, {_q(p)})" for p in all_]
        if any_:
            tests.append("(" + " OR ".join(f"contains({plain}, {_q(p)})" for p in any_) + ")")
        arms.append(f"WHEN {' AND '.join(tests)} THEN {_q(name)}")
    return "CASE " + " ".join(arms) + " END"


def _family_sql(licence: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace(upper({licence}), '(-ONLY)+$', ''), '(-OR-LATER)+$', ''), '\\++$', '')"
    arms = []
    for name, kind, value in R.FAMILY_RULES:
        test = {"prefix": f"starts_with({bare}, {_q(value)})", "equal": f"{bare} = {_q(value)}"}.get(kind) or " AND ".join(f"contains({bare}, {_q(v)})" for v in value.split("|"))
        arms.append(f"WHEN {test} THEN {_q(name)}")
    return f"CASE WHEN {licence} IS NULL THEN NULL {' '.join(arms)} ELSE 'Unknown' END"


_EMAIL = r"regexp_matches(text, '[\p{L}\p{N}]@[\p{L}\p{N}].{0,47}\.', 's')"
_IP = "len(list_filter(regexp_split_to_array(text, '[^0-9.]+'), lambda r: regexp_full_match(r, '[0-9]{1,9}(\\.[0-9]{1,9}){3}') AND len(list_filter(string_split(r, '.'), lambda o: TRY_CAST(o AS INTEGER) > 255)) = 0)) > 0"
_DOCS = "SELECT doc_id AS ord, 'documents/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text FROM documents"
_GEODATA = _values([(i, *g) for i, g in enumerate(R.GEODATA)])
_ASSIGNED = r"regexp_matches(lower(line), '(password|token|secret)[ \t\n\x0b\f\r]*[=:][ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]')"
_SECRET_KINDS = ", ".join([f"CASE WHEN regexp_matches(line, {_q(p)}) THEN {{'kind': {i}, 'secret': {_q(n)}}} END" for i, (n, p) in enumerate(R.SECRETS)] + [f"CASE WHEN {_ASSIGNED} THEN {{'kind': {len(R.SECRETS)}, 'secret': 'Assigned secret'}} END"])
_SECRET_LINES = f"""SELECT ord, path, line_no, s.kind AS kind, s.secret AS secret, CASE WHEN length(trim(line)) > 20 THEN left(trim(line), 8) || '...' || right(trim(line), 4) ELSE left(trim(line), 8) || '...' END AS redacted
FROM (SELECT *, unnest(list_filter([{_SECRET_KINDS}], lambda x: x IS NOT NULL)) AS s FROM (SELECT ord, path, regexp_replace(unnest(ls), '\\r$', '') AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM (SELECT ord, path, string_split(text, chr(10)) AS ls FROM ({_DOCS}))))"""
_DETECTED = f"""
f AS (SELECT *, {_plain_sql("text")} AS plain FROM ({_DOCS})),
l AS (SELECT *, {_licence_sql("plain")} AS licence FROM f),
m AS (SELECT *, {_family_sql("licence")} AS family FROM l),
t(vtype, category, severity, sev_rank) AS ({_values(findings.type_rows())}),
raw AS (
  SELECT ord, 1 AS det, 0 AS sub, 'license_text' AS phase, CASE WHEN family IN ('StrongCopyleft', 'NetworkCopyleft') THEN 'CopyleftInProprietary' WHEN family = 'CreativeCommonsRestricted' THEN 'CcNonCommercialViolation' WHEN family = 'SourceAvailable' THEN 'CommercialUseViolation' END AS vtype, path AS file, 0.9 AS confidence, licence AS evidence FROM m WHERE licence IS NOT NULL
  UNION ALL
  SELECT ord, 2, 0, 'license_text', 'ChimeraLicense', path, 0.85, array_to_string(fams, ',') FROM (SELECT *, list_filter([{", ".join(f"CASE WHEN contains(plain, {_q(p)}) THEN {_q(n)} END" for p, n in R.CHIMERA_SIGNATURES)}], lambda x: x IS NOT NULL) AS fams FROM f) WHERE len(fams) >= 3
  UNION ALL
  SELECT ord, 3, 0, 'data_rights', 'PiiExposure', path, 0.8, 'email' FROM f WHERE {_EMAIL}
  UNION ALL
  SELECT ord, 4, 0, 'data_rights', 'PiiExposure', path, 0.7, 'ip' FROM f WHERE {_IP}
  UNION ALL
  SELECT ord, 5, d.sub, 'data_rights', 'MlDatasetViolation', path, 0.75, d.dataset FROM f JOIN ({_values([(i, n) for i, (n, _) in enumerate(R.ML_DATASETS)])}) AS d(sub, dataset) ON contains(lower(text), d.dataset)
  UNION ALL
  SELECT ord, 6, min(g.sub), 'data_rights', 'UnlicensedGeodata', path, 0.8, g.provider FROM f JOIN ({_GEODATA}) AS g(sub, mark, provider, licence, attribution) ON contains(lower(text), g.mark) GROUP BY ord, path, g.provider
  UNION ALL
  SELECT ord, 7, line_no * 100 + kind, 'data_rights', 'ExposedSecrets', path, 0.9, secret || ' line ' || line_no || ': ' || redacted FROM ({_SECRET_LINES})
  UNION ALL
  SELECT ord, 8, 0, 'attribution', 'MissingAttribution', path, 0.5, CAST((length(lower(text)) - length(replace(lower(text), 'all rights reserved', ''))) // 19 AS VARCHAR) FROM f WHERE contains(lower(text), 'all rights reserved')
),
numbered AS (SELECT *, ord * 1000000 + row_number() OVER (PARTITION BY ord ORDER BY det, sub) - 1 AS place FROM raw),
found AS (SELECT r.place AS ord, r.phase, r.vtype, r.file, t.severity, t.sev_rank, CAST(r.confidence AS DOUBLE) AS confidence, r.evidence FROM numbered r JOIN t USING (vtype)),
rules(vtype, other) AS ({_values(findings.correlation_rows())}),
hit AS (SELECT DISTINCT a.file, a.vtype FROM found a JOIN rules r ON a.vtype = r.vtype JOIN found b ON b.file = a.file AND b.vtype = r.other),
corr AS (
  SELECT ord, phase, found.vtype, found.file, [ 'Low', 'Medium', 'High', 'Critical' ][CASE WHEN hit.file IS NOT NULL AND sev_rank IN (2, 3) THEN sev_rank + 1 ELSE sev_rank END] AS severity,
         CASE WHEN hit.file IS NOT NULL AND sev_rank IN (2, 3) THEN sev_rank + 1 ELSE sev_rank END AS sev_rank,
         CASE WHEN hit.file IS NOT NULL THEN least(1.0::DOUBLE, confidence * 1.3::DOUBLE) ELSE confidence END AS confidence, evidence, hit.file IS NOT NULL AS corroborated
  FROM found LEFT JOIN hit ON hit.file = found.file AND hit.vtype = found.vtype
),
dedup AS (
  SELECT min(ord) AS ord, arg_min(phase, ord) AS phase, vtype, file, [ 'Low', 'Medium', 'High', 'Critical' ][max(sev_rank)] AS severity, max(sev_rank) AS sev_rank, max(confidence) AS confidence,
         string_agg(evidence, '; ' ORDER BY ord) AS evidence, count(*) AS merged
  FROM corr GROUP BY vtype, file
)
"""


# ---------------------------------------------------------------- licences


@query(f"WITH p AS (SELECT {_plain_sql('text')} AS plain FROM documents), l AS (SELECT {_licence_sql('plain')} AS licence FROM p) SELECT licence, {_family_sql('licence')} AS family, count(*) AS documents FROM l WHERE licence IS NOT NULL GROUP BY ALL")
def license_phrase_counts(spark, sf_dir):
    licence = _docs(spark, sf_dir).select(licence_of_text(F.col("text")).alias("licence")).filter("licence IS NOT NULL")
    return licence.groupBy("licence", family(F.col("licence")).alias("family")).agg(F.count("*").alias("documents"))


_IDS = ["GPL-2.0-only", "GPL-3.0+", "AGPL-3.0-or-later", "LGPL-2.1-only", "MIT", "MIT WITH Commons-Clause", "Apache-2.0", "BSD-3-Clause", "BSL-1.0", "BUSL-1.1", "Elastic-2.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "Proprietary", "NONE", "OpenRAIL", "MPL-2.0", "EUPL-1.2", "0BSD", "Llama-3", "Foo-1.0", ""]


@query(f"SELECT part, id, family, family IN ({', '.join(map(_q, R.COPYLEFT))}) AS copyleft, family IN ({', '.join(map(_q, R.PERMISSIVE))}) AS permissive FROM (SELECT part, id, {_family_sql('id')} AS family FROM {dealt_sql([(i,) for i in _IDS], 'id')})")
def license_family_ladder(spark, sf_dir):
    ids = dealt(spark, sf_dir, [(i,) for i in _IDS], "id").withColumn("family", family(F.col("id")))
    return ids.select("part", "id", "family", is_copyleft(F.col("family")).alias("copyleft"), is_permissive(F.col("family")).alias("permissive"))


@query()
def license_compatibility_matrix(spark, sf_dir):
    pairs = dealt(spark, sf_dir, [(a, b) for a in _IDS if a for b in _IDS if b], "upstream", "downstream")
    no, yes = F.lit(False), F.lit(True)
    up, down = F.col("upstream"), F.col("downstream")
    return pairs.select("part", "upstream", "downstream", compatibility(up, down, no, no, no).alias("plain"), compatibility(up, down, yes, yes, yes).alias("strict"))


@query(f"SELECT doc_id, len(fams) AS families FROM (SELECT doc_id, list_distinct(list_filter([{', '.join(f'CASE WHEN contains(plain, {_q(p)}) THEN {_q(n)} END' for p, n in R.CHIMERA_SIGNATURES)}], lambda x: x IS NOT NULL)) AS fams FROM (SELECT doc_id, {_plain_sql('text')} AS plain FROM documents)) WHERE len(fams) > 0")
def chimera_signals(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(families_in_text(F.col("text"))).cast("long").alias("families")).filter("families > 0")


_ODD = "".join(R.LOOKALIKES) + "".join(R.DROPPED) + "".join(R.SPACES)


@query(f"SELECT source, count(*) AS documents, sum(length(text) - length(translate(text, {_q(_ODD)}, '')))::BIGINT AS anomalies FROM documents GROUP BY source")
def unicode_anomalies(spark, sf_dir):
    odd = F.length("text") - F.length(F.translate(F.col("text"), _ODD, ""))
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.sum(odd).cast("long").alias("anomalies"))


@query()
def spdx_expressions(spark, sf_dir):
    rows = ["MIT", "MIT OR Apache-2.0", "GPL-2.0-only OR MIT", "GPL-2.0-only WITH Classpath-exception-2.0", "(MIT OR Apache-2.0) AND CC-BY-4.0", "MIT AND", "", "(MIT"]
    return dealt(spark, sf_dir, [(r,) for r in rows], "expression").select("part", "expression", spdx("expression").alias("s")).select("part", "expression", "s.*")


# ---------------------------------------------------------------- text and similarity


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


@query(
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
    h AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 4], ' ')) AS d FROM g),
    b AS (SELECT doc_id, i, d[15:16] || d[13:14] || d[11:12] || d[9:10] || d[7:8] || d[5:6] || d[3:4] || d[1:2] AS h FROM h),
    m AS (SELECT doc_id, min(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS h, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM b)
    SELECT doc_id, count(DISTINCT h) AS fingerprints, min(h) AS least FROM m WHERE n = 4 GROUP BY doc_id
    """
)
def winnow_fingerprints(spark, sf_dir):
    prints = _docs(spark, sf_dir).select("doc_id", T.winnowed("text").alias("w")).filter(F.size("w") > 0)
    return prints.select("doc_id", F.size("w").cast("long").alias("fingerprints"), F.array_min("w").alias("least"))


_GRAMS = r"SELECT DISTINCT {id}, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT {id}, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM {t}) WHERE len(ws) >= 3)"


@query(f"WITH d AS ({_GRAMS.format(id='doc_id', t='documents')}), b AS ({_GRAMS.format(id='item_id', t='benchmark')}), n AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id) SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(size)::DOUBLE, 6) AS share FROM d JOIN b USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.5 * any_value(size)")
def benchmark_overlap(spark, sf_dir):
    """Documents that hold at least half of a benchmark passage's trigrams."""
    grams = lambda df, key: df.select(key, T.ngrams(T.tokens(F.lower("text")), 3).alias("gs"))
    bench = grams(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id").withColumn("size", F.size("gs"))
    left = grams(_docs(spark, sf_dir), "doc_id").select("doc_id", F.explode("gs").alias("g"))
    shared = left.join(bench.select("item_id", "size", F.explode("gs").alias("g")), "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.first("size").alias("size"))
    return shared.filter("shared >= 0.5 * size").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("share"))


#: Query vectors and compared vectors of one cell of :func:`embedding_cosine`.
_CELL = (256, 4096)


def _cosines(asked: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """:func:`T.cosine` of all pairs of a cell, vectors of one length by one matrix product."""
    out = np.zeros((len(asked), len(others)))
    sizes = [np.asarray([len(v) for v in side], np.int64) for side in (asked["q"], others["e"])]
    for size in set(sizes[0].tolist()) & set(sizes[1].tolist()) - {0}:
        i, j = (np.flatnonzero(s == size) for s in sizes)
        x, y = np.stack(asked["q"].to_numpy()[i]), np.stack(others["e"].to_numpy()[j])
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
            c = x @ y.T / norm
        out[np.ix_(i, j)] = np.where(norm == 0, 0.0, np.clip(np.where(np.isnan(c), 1.0, c), 0.0, 1.0))
    a, b = asked["query_id"].to_numpy(), others["vec_id"].to_numpy()
    i, j = np.nonzero(a[:, None] != b)
    return pd.DataFrame({"query_id": a[i], "vec_id": b[j], "cosine": out[i, j]})


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS dot, sqrt(list_dot_product(a.e, a.e)) AS x, sqrt(list_dot_product(b.e, b.e)) AS y FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, round(CASE WHEN x = 0 OR y = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, dot / (x * y))) END, 5) AS cosine FROM p")
def embedding_cosine(spark, sf_dir):
    """Cosine of each vector whose id is divisible by 50 with every other: both sides meet in cells of bounded size."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.withColumn("odd", F.col("e").isNull() | F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n, queries, odd = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % 50 == 0), F.count_if("odd")).first()
    blocks, chunks = -(-queries // _CELL[0]) or 1, -(-n // _CELL[1]) or 1
    place = lambda k: F.pmod(F.xxhash64("vec_id"), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), F.col("odd").alias("odd_q"), place(blocks).alias("block"), every(chunks).alias("chunk"))
    others = rows.filter("vec_id IS NOT NULL").select("vec_id", "e", "odd", place(chunks).alias("chunk"), every(blocks).alias("block"))
    keys = ["block", "chunk"]
    found = asked.filter("NOT odd_q").drop("odd_q").groupBy(*keys).cogroup(others.filter("NOT odd").drop("odd").groupBy(*keys)).applyInPandas(_cosines, "query_id long, vec_id long, cosine double")
    if odd:  # vectors that are null or hold what is no number
        pairs = asked.join(others, keys).filter("query_id <> vec_id AND (odd_q OR odd)")
        found = found.unionByName(pairs.select("query_id", "vec_id", T.cosine(F.col("q"), F.col("e")).alias("cosine")))
    return found.select("query_id", "vec_id", F.round("cosine", 5).alias("cosine"))


@query()
def code_fingerprints(spark, sf_dir):
    prints = code.fingerprint(_files(spark, sf_dir))
    return prints.select("ord", "normal_hash", F.size("winnow").alias("fingerprints"), F.size("grams").alias("trigrams"), "loc")


def _benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("ord"), F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), "text")


@query()
def snippet_matches(spark, sf_dir):
    """Documents that are alike to a benchmark passage."""
    return code.matches(code.fingerprint(_files(spark, sf_dir)), code.fingerprint(_benchmark_files(spark, sf_dir)))


@query()
def text_entropy(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(code.byte_entropy("text"), 6).alias("entropy"))


_WORDS = "string_split(p_name, ' ')"
_PASCAL = f"array_to_string(list_transform({_WORDS}, lambda w: upper(w[1]) || w[2:]), '')"


@query(f"SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN lower({_PASCAL}[1]) || {_PASCAL}[2:] WHEN 1 THEN {_PASCAL} WHEN 2 THEN replace(p_name, ' ', '-') ELSE replace(p_name, ' ', '_') END AS id, lower(replace(p_name, ' ', '_')) AS stem FROM part")
def identifier_stems(spark, sf_dir):
    """Names of parts as identifiers of four kinds, and their common stem."""
    pascal = F.array_join(F.transform(F.split("p_name", " "), F.initcap), "")
    kind = F.pmod("p_partkey", F.lit(4))
    id_ = F.when(kind == 0, F.concat(F.lower(F.left(pascal, F.lit(1))), F.substr(pascal, F.lit(2)))).when(kind == 1, pascal).otherwise(F.translate("p_name", " ", "-"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("part"), F.when(kind == 3, F.translate("p_name", " ", "_")).otherwise(id_).alias("id"))
    return parts.select("part", "id", T.stem(F.col("id")).alias("stem"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?:src|href)=[\"'']([^\"'']+)[\"'']', 1)) AS links FROM pages")
def page_links(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(code.links(F.col("html"))).cast("long").alias("links"))


@query()
def page_obfuscation(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", code.obfuscation(F.col("html")).alias("score"), F.size(code.endpoints(F.col("html"))).alias("endpoints"))


_BRANCH_KEYS = [k for letter, _, keys in structure.NODES if letter in structure.BRANCHES for k in keys]


@query("SELECT doc_id, CAST(1 + " + " + ".join(f"(length(l) - length(replace(l, {_q(k)}, ''))) // {len(k)}" for k in _BRANCH_KEYS) + " AS INTEGER) AS complexity FROM (SELECT doc_id, lower(text) AS l FROM documents)")
def text_complexity(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", structure.complexity(structure.signature(F.col("text"))).cast("int").alias("complexity"))


@query()
def header_findings(spark, sf_dir):
    return headers.header_findings(_files(spark, sf_dir), "MIT").groupBy("vtype").agg(F.count("*").alias("files"))


@query()
def file_set_comparison(spark, sf_dir):
    """Documents that repeat a benchmark passage."""
    return compare(_benchmark_files(spark, sf_dir), _files(spark, sf_dir))


# ---------------------------------------------------------------- data rights


@query(f"SELECT doc_id FROM documents WHERE {_EMAIL}")
def pii_email(spark, sf_dir):
    return _docs(spark, sf_dir).filter(data_rights.has_email(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {_IP}")
def pii_ipv4(spark, sf_dir):
    return _docs(spark, sf_dir).filter(data_rights.has_ipv4(F.col("text"))).select("doc_id")


@query(f"SELECT role, count(*) AS turns, CAST(count_if({_EMAIL}) AS BIGINT) AS with_email, CAST(count_if({_IP}) AS BIGINT) AS with_ip FROM conversations GROUP BY role")
def conversation_pii(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.groupBy("role").agg(F.count("*").alias("turns"), F.count_if(data_rights.has_email(F.col("text"))).alias("with_email"), F.count_if(data_rights.has_ipv4(F.col("text"))).alias("with_ip"))


@query(f"SELECT d.dataset, d.licence, count(*) AS documents, min(doc_id) AS first_id FROM documents JOIN ({_values(R.ML_DATASETS)}) AS d(dataset, licence) ON contains(lower(text), d.dataset) GROUP BY ALL")
def ml_dataset_mentions(spark, sf_dir):
    found = data_rights.ml_datasets(_files(spark, sf_dir))
    return found.groupBy("dataset", "licence").agg(F.count("*").alias("documents"), F.min("ord").alias("first_id"))


@query(f"SELECT d.pattern, d.licence, count(*) AS documents FROM documents JOIN ({_values(R.DATA_LICENSES)}) AS d(pattern, licence) ON contains(lower(text), d.pattern) GROUP BY ALL")
def data_licence_mentions(spark, sf_dir):
    return data_rights.data_licences(_files(spark, sf_dir)).groupBy("pattern", "licence").agg(F.count("*").alias("documents"))


@query(f"SELECT ord, line_no, secret, redacted FROM ({_SECRET_LINES})")
def secret_lines(spark, sf_dir):
    """Lines with a secret of any kind, a row per kind."""
    return data_rights.secret_lines(_files(spark, sf_dir)).select("ord", "line_no", "secret", "redacted")


@query(f"SELECT provider, arg_min(licence, sub) AS licence, attribution, count(DISTINCT ord) AS documents FROM (SELECT ord, provider, min(sub) AS sub, arg_min(licence, sub) AS licence, attribution FROM ({_DOCS}) JOIN ({_GEODATA}) AS g(sub, mark, provider, licence, attribution) ON contains(lower(text), mark) GROUP BY ord, provider, attribution) GROUP BY provider, licence, attribution")
def geodata_providers(spark, sf_dir):
    """Documents per provider of map data that they name, with its licence."""
    return data_rights.geodata(_files(spark, sf_dir)).groupBy("provider", "licence", "attribution").agg(F.count("*").alias("documents"))


#: Data files with a header.
_HEADERS = [("a.csv", "name,email,phone\nJohn,john@x.com,555\n"), ("b.csv", "id,price\n1,2\n"), ("c.csv", "phone,note,email")]


@query()
def pii_columns(spark, sf_dir):
    rows = dealt(spark, sf_dir, _HEADERS, "path", "text").select("part", "path", F.explode(data_rights.header_columns(F.col("text"))).alias("column"))
    return rows.select("part", "path", "column", data_rights.pii_of_column(F.col("column")).alias("kind"))


# ---------------------------------------------------------------- findings


@query(f"WITH {_DETECTED} SELECT vtype, severity, count(*) AS findings, round(sum(confidence), 6) AS confidence FROM found GROUP BY ALL")
def detected_findings(spark, sf_dir):
    return detect(_files(spark, sf_dir)).groupBy("vtype", "severity").agg(F.count("*").alias("findings"), F.round(F.sum("confidence"), 6).alias("confidence"))


@query(f"WITH {_DETECTED} SELECT ord, vtype, file, severity, sev_rank::INTEGER AS sev_rank, round(confidence, 6) AS confidence, corroborated FROM corr")
def correlated_findings(spark, sf_dir):
    found = findings.correlate(detect(_files(spark, sf_dir)))
    return found.select("ord", "vtype", "file", "severity", "sev_rank", F.round("confidence", 6).alias("confidence"), "corroborated")


@query(f"WITH {_DETECTED} SELECT ord, vtype, file, severity, round(confidence, 6) AS confidence, evidence, merged FROM dedup")
def scanned_findings(spark, sf_dir):
    return scan(_files(spark, sf_dir)).select("ord", "vtype", "file", "severity", F.round("confidence", 6).alias("confidence"), "evidence", "merged")


@query(f"WITH {_DETECTED} SELECT count(*) AS total, CAST(count_if(sev_rank = 1) AS BIGINT) AS low, CAST(count_if(sev_rank = 2) AS BIGINT) AS medium, CAST(count_if(sev_rank = 3) AS BIGINT) AS high, CAST(count_if(sev_rank = 4) AS BIGINT) AS critical FROM dedup")
def severity_counts(spark, sf_dir):
    return findings.severity_counts(scan(_files(spark, sf_dir)))


@query(f"WITH {_DETECTED}, w(vtype, multiplier) AS ({_values(findings.multiplier_rows(findings.Policy()))}), s AS (SELECT file, least(100, sum(CAST(trunc([1, 5, 15, 30][sev_rank] * coalesce(multiplier, 1.0)::DOUBLE * confidence) AS INTEGER)))::INTEGER AS score FROM dedup LEFT JOIN w USING (vtype) GROUP BY file) SELECT file, score, CASE WHEN score = 0 THEN 'Clean' WHEN score <= 20 THEN 'Low' WHEN score <= 50 THEN 'Medium' WHEN score <= 80 THEN 'High' ELSE 'Critical' END AS level FROM s")
def risk_by_file(spark, sf_dir):
    weights = spark.createDataFrame(findings.multiplier_rows(findings.Policy()), "vtype string, multiplier double")
    points = (findings.base_score(F.col("sev_rank")) * F.coalesce("multiplier", F.lit(1.0)) * F.col("confidence")).cast("int")
    scored = scan(_files(spark, sf_dir)).join(F.broadcast(weights), "vtype", "left").groupBy("file").agg(F.least(F.lit(100), F.sum(points)).cast("int").alias("score"))
    return scored.withColumn("level", findings.risk_level(F.col("score")))


@query()
def risk_score(spark, sf_dir):
    return findings.risk_score(scan(_files(spark, sf_dir)))


@query(f"SELECT part, vtype, category, severity, sev_rank FROM {dealt_sql(findings.type_rows(), 'vtype', 'category', 'severity', 'sev_rank')}")
def finding_types(spark, sf_dir):
    """What is known of the types of findings that parts were dealt."""
    found = dealt(spark, sf_dir, [(r[0],) for r in findings.type_rows()], "vtype")
    return found.join(F.broadcast(findings.finding_types(spark)), "vtype").select("part", "vtype", "category", "severity", "sev_rank")


@query(f"WITH {_DETECTED} SELECT vtype, count(*) AS n FROM found WHERE sev_rank >= 3 AND vtype <> 'MlDatasetViolation' AND NOT contains(file, '/1') GROUP BY vtype")
def policy_filtered(spark, sf_dir):
    policy = findings.Policy(min_severity=3, ignored_types=["MlDatasetViolation"], ignored_paths=["/1"])
    return findings.apply_policy(detect(_files(spark, sf_dir)), policy).groupBy("vtype").agg(F.count("*").alias("n"))


@query(f"WITH {_DETECTED} SELECT vtype AS rule, arg_min(CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' ELSE 'note' END, ord) AS level, count(*) AS results FROM dedup GROUP BY vtype")
def sarif_rules(spark, sf_dir):
    return reports.sarif_rules(scan(_files(spark, sf_dir)))


@query()
def sarif_results(spark, sf_dir):
    return reports.sarif_results(scan(_files(spark, sf_dir)))


@query()
def evidence_chains(spark, sf_dir):
    return findings.evidence_chain(scan(_files(spark, sf_dir)), "scan", "1970-01-01T00:00:00Z")


# ---------------------------------------------------------------- supply chain

_DEPS = [("npm", "lodahs", "^4.0.0"), ("npm", "react", "18.2.0"), ("npm", "request", "=2.88.0"), ("npm", "expresss", "*"), ("npm", "colors", "1.4.0"), ("pypi", "reqests", "2.0"), ("pypi", "numpy", None), ("crates", "serde", "1"), ("crates", "tokioo", "~1"), ("npm", "@types/node", "20.1.1")]


_DEPS_SQL = dealt_sql(_DEPS, "ecosystem", "name", "version_spec")


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, _DEPS, "ecosystem", "name", "version_spec").drop("part")


def _own_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's dependency under a name of its own."""
    return dealt(spark, sf_dir, _DEPS, "ecosystem", "name", "version_spec").select("ecosystem", F.concat("name", F.lit("-"), F.col("part").cast("string")).alias("name"), "version_spec")


_POPULAR = _values([(e, p) for e, names in R.POPULAR.items() for p in names])


@query(f"WITH d AS (SELECT ecosystem, name, version_spec FROM {_DEPS_SQL}), p(ecosystem, popular) AS ({_POPULAR}) SELECT d.ecosystem, d.name, popular, levenshtein(d.name, popular)::INTEGER AS distance, round(1 - levenshtein(d.name, popular) / greatest(length(d.name), length(popular))::DOUBLE, 6) AS confidence FROM d JOIN p USING (ecosystem) WHERE levenshtein(d.name, popular) BETWEEN 1 AND CASE WHEN length(popular) <= 4 THEN 1 WHEN length(popular) <= 10 THEN 2 ELSE 3 END AND NOT EXISTS (SELECT 1 FROM p q WHERE q.ecosystem = d.ecosystem AND q.popular = d.name)")
def typosquats(spark, sf_dir):
    return supply_chain.typosquats(_deps(spark, sf_dir))


@query(f"WITH d AS (SELECT ecosystem, name, version_spec FROM {_DEPS_SQL}) SELECT ecosystem, name, unnest(list_filter([CASE WHEN name IN ({', '.join(map(_q, R.DISPUTED))}) THEN 'disputed' END, CASE WHEN ecosystem = 'npm' AND name IN ({', '.join(map(_q, R.DEPRECATED))}) THEN 'deprecated' END, CASE WHEN NOT coalesce(regexp_full_match(trim(version_spec), '=?[0-9.]+'), false) THEN 'unpinned' END], lambda x: x IS NOT NULL)) AS flag FROM d")
def flagged_dependencies(spark, sf_dir):
    return supply_chain.flagged(_deps(spark, sf_dir))


_NODES = [("app", "MIT", "Static"), ("lib-a", "Apache-2.0", "Static"), ("lib-b", "GPL-3.0-only", "Static"), ("lib-c", "LGPL-2.1-only", "Dynamic"), ("tool", "MIT", "Static")]
_EDGES = [("app", "lib-a"), ("lib-a", "lib-b"), ("app", "lib-c"), ("tool", "lib-b"), ("lib-b", "lib-a")]


@query(
    f"""
    WITH RECURSIVE n AS (SELECT name || '-' || p_partkey AS name, licence, linking FROM part, ({_values(_NODES)}) v(name, licence, linking)), e AS (SELECT src || '-' || p_partkey AS src, dst || '-' || p_partkey AS dst FROM part, ({_values(_EDGES)}) v(src, dst)),
    w(package, source, family, depth) AS (
      SELECT e.src, n.name, 'StrongCopyleft', 1 FROM e JOIN n ON e.dst = n.name WHERE n.licence = 'GPL-3.0-only'
      UNION ALL SELECT e.src, w.source, w.family, w.depth + 1 FROM w JOIN e ON e.dst = w.package WHERE w.depth < 32
    ) SELECT package, source, family, min(depth) AS depth FROM w WHERE package <> source GROUP BY ALL
    """
)
def contamination_paths(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey IS NOT NULL")
    rows = lambda fixed, *names: part.select(F.concat(F.lit("-"), F.col("p_partkey").cast("string")).alias("_k"), F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(r, names, strict=True))) for r in fixed))).alias("_r"))
    nodes = rows(_NODES, "name", "licence", "linking").select(F.concat("_r.name", "_k").alias("name"), "_r.licence", "_r.linking")
    edges = rows(_EDGES, "src", "dst").select(F.concat("_r.src", "_k").alias("src"), F.concat("_r.dst", "_k").alias("dst"))
    return contamination.contaminated(nodes, edges)


@query()
def manifest_dependencies(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("string").alias("k"))
    of = lambda name, text: part.select(F.concat("k", F.lit(f"/{name}")).alias("path"), F.replace(F.lit(text), F.lit("{k}"), F.col("k")).alias("text"))
    npm = of("package.json", '{"dependencies": {"react-{k}": "18.2.{k}"}, "devDependencies": {"jest": "^{k}"}}')
    pip = of("requirements.txt", "# c\nnumpy==1.{k}\nflask-{k}>=2.{k},<3\nsix\n")
    return supply_chain.npm_dependencies(npm).drop("section").unionByName(supply_chain.python_requirements(pip))


@query()
def spdx_packages(spark, sf_dir):
    return reports.spdx_packages(_own_deps(spark, sf_dir))


@query()
def cyclonedx_components(spark, sf_dir):
    return reports.cyclonedx_components(_own_deps(spark, sf_dir))


# ---------------------------------------------------------------- sources


@query()
def input_kinds(spark, sf_dir):
    rows = ["./src", "npm:react@18", "https://github.com/a/b", "https://example.com", "https://example.com/a.js", "docker:nginx", "a.apk", "b.wasm", "-", "git@github.com:a/b.git", "c.zip", "d.asar", "crx:abc"]
    return dealt(spark, sf_dir, [(r,) for r in rows], "target").select("part", "target", input_kind(F.col("target")).alias("kind"))


@query()
def package_specs(spark, sf_dir):
    rows = ["npm:react@18.2.0", "npm:@types/node@20", "npm:@types/node", "pip:numpy", "crate:serde@1", "crx:abc"]
    return dealt(spark, sf_dir, [(r,) for r in rows], "spec").select("part", "spec", package_spec(F.col("spec")).alias("p")).select("part", "spec", "p.*")


@query()
def file_categories(spark, sf_dir):
    rows = ["LICENSE", "src/a.rs", "package.json", "x/b.JS", "data.csv", "img.png", "f.woff2", "README", "a.md"]
    return dealt(spark, sf_dir, [(r,) for r in rows], "path").select("part", "path", category(F.col("path")).alias("category"))
