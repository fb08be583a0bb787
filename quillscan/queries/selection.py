"""Queries over selections of files, which orders stand for, and over risk tables of data rights."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import refdata as R
from ..catalog import _DETECTED, _DOCS, _EMAIL, _IP, _SECRET_LINES, _files, _q, _values, dealt, dealt_sql, query
from ..operators import selection as S
from ..operators.data_rights import has_email, has_ipv4, secrets_of
from ..plans.scan import detect
from ..sources import files as FS

_EXT = ["js", "ts", "py", "css", "md", "rs", "tsx", "png"]
_NAMES = ["a", "LICENSE", "notice", "x"]
_PATH = f"'d/' || (o_custkey % 7) || CASE WHEN o_orderkey % 3 = 0 THEN '/e/f' ELSE '' END || '/' || [{', '.join(map(_q, _NAMES))}][o_orderkey % 4 + 1] || '.' || [{', '.join(map(_q, _EXT))}][o_orderkey % 8 + 1]"
_INDEX = f"""o AS (SELECT {_PATH} AS path, [{', '.join(map(_q, _EXT))}][o_orderkey % 8 + 1] AS ext, CAST(floor(o_totalprice) AS BIGINT) % 100000 AS size, o_orderkey FROM orders),
f AS (SELECT *, CASE WHEN regexp_matches(path, '/(LICENSE|notice)[^/]*$') THEN 'License' WHEN ext IN ('js') THEN 'JavaScript' WHEN ext IN ('ts', 'tsx') THEN 'TypeScript' WHEN ext IN ('py', 'rs') THEN 'SourceCode' WHEN ext = 'css' THEN 'Stylesheet' WHEN ext = 'md' THEN 'Document' ELSE 'Image' END AS category FROM o)"""


def _index(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % n + 1).cast("int"))
    folder = F.concat(F.lit("d/"), (F.col("o_custkey") % 7).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "/e/f").otherwise(""))
    path = F.concat(folder, F.lit("/"), pick(_NAMES, 4), F.lit("."), pick(_EXT, 8))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", path.alias("path"), (F.floor("o_totalprice") % 100_000).cast("long").alias("size"))
    return rows.select("o_orderkey", "path", FS.extension(F.col("path")).alias("ext"), "size", FS.category(F.col("path")).alias("category"))


_IN = lambda names: ", ".join(map(_q, names))


@query(
    f"""WITH {_INDEX}, u AS (SELECT category IN ('SourceCode', 'JavaScript', 'TypeScript') AS code, category IN ('JavaScript', 'TypeScript') AS js, * FROM f)
    SELECT category, count_if(code) AS source_code, count_if(code AND ext IN ({_IN(S.FINGERPRINTED)}) AND size > 200) AS fingerprintable, count_if(code AND ext IN ({_IN(S.TRACED)}) AND size > 500) AS traceable, count_if(js AND size > 2000) AS script_candidate, count_if(category = 'JavaScript' AND size >= 50000) AS large_script FROM u GROUP BY category"""
)
def file_uses(spark, sf_dir):
    index = _index(spark, sf_dir)
    flags = [c for c in S.uses_of(index).columns if c != "path"]
    return S.uses_of(index).withColumn("category", FS.category(F.col("path"))).groupBy("category").agg(*(F.count_if(c).alias(c) for c in flags))


@query(f"WITH {_INDEX} SELECT path, count(*) AS files, sum(size)::BIGINT AS bytes FROM f WHERE regexp_matches(upper(path), '(LICENSE|LICENCE|COPYING|NOTICE)[^/]*$') AND len(string_split(path, '/')) <= 3 GROUP BY path")
def licence_file_index(spark, sf_dir):
    return S.licence_files(_index(spark, sf_dir)).groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {_INDEX} SELECT ext, count(*) AS files FROM f WHERE ext IN ('js', 'css') GROUP BY ext")
def files_of_extensions(spark, sf_dir):
    return S.of_extensions(_index(spark, sf_dir), "JS", "css").groupBy("ext").agg(F.count("*").alias("files"))


@query(f"WITH {_DETECTED} SELECT 'Data Rights' AS category, vtype, count(*) AS findings FROM found WHERE vtype IN ({_IN([n for n, c, _ in R.FINDING_TYPES if c == 'Data Rights'])}) GROUP BY vtype")
def data_rights_findings(spark, sf_dir):
    return S.by_category(detect(_files(spark, sf_dir)), "Data Rights").groupBy("vtype").agg(F.count("*").alias("findings")).withColumn("category", F.lit("Data Rights"))


@query(f"WITH {_DETECTED} SELECT DISTINCT vtype FROM found")
def finding_kinds(spark, sf_dir):
    return S.kinds(detect(_files(spark, sf_dir)))


@query(f"WITH {_DETECTED} SELECT coalesce(bool_or(severity = 'Critical'), false) AS has_critical FROM found")
def has_critical(spark, sf_dir):
    return S.has_critical(detect(_files(spark, sf_dir)))


_KINDS = [k for k, *_ in S.PII_RISKS] + ["Other"]


@query(
    f"""WITH r(kind, risk) AS ({_values([(k, r) for k, r, _, _ in S.PII_RISKS])}), g(kind, n) AS ({_values([(k, len(g)) for k, _, _, g in S.PII_RISKS])})
    SELECT part, k.kind, coalesce(risk, 'None') AS risk, coalesce(n, 2) AS regulations, CASE WHEN risk IN ('Medium', 'High', 'Critical') THEN risk ELSE 'Medium' END AS at_least_medium FROM {dealt_sql([(k,) for k in _KINDS], 'kind')} k LEFT JOIN r USING (kind) LEFT JOIN g USING (kind)"""
)
def pii_risks(spark, sf_dir):
    rows = dealt(spark, sf_dir, [(k,) for k in _KINDS], "kind").withColumn("risk", S.pii_risk(F.col("kind")))
    return rows.select("part", "kind", "risk", F.size(S.regulations(F.col("kind"))).alias("regulations"), S.greater_risk(F.col("risk"), F.lit("Medium")).alias("at_least_medium"))


_POINTS = "coalesce(CASE kind " + " ".join(f"WHEN {_q(r[0])} THEN {r[2]}" for r in S.PII_RISKS) + " END, 5)"


@query(
    f"""SELECT folder, CAST(least(100, sum(points)) AS INTEGER) AS risk FROM (
      SELECT ord % 50 AS folder, {_POINTS} AS points FROM (SELECT ord, 'Email' AS kind FROM ({_DOCS}) WHERE {_EMAIL} UNION ALL SELECT ord, 'IpAddress' FROM ({_DOCS}) WHERE {_IP})
      UNION ALL SELECT ord % 50, 15 FROM ({_SECRET_LINES}) UNION ALL SELECT ord % 50, 3 FROM ({_DOCS}) WHERE strlen(text) > 20000) GROUP BY folder"""
)
def data_rights_risk(spark, sf_dir):
    """Risk of each of fifty folders of documents, from all kinds of personal data, secrets, and data files."""
    files = _files(spark, sf_dir).withColumn("folder", F.col("ord") % 50)
    text = F.col("text")
    kinds = files.select("folder", F.explode(F.array_compact(F.array(F.when(has_email(text), F.lit("Email")), F.when(has_ipv4(text), F.lit("IpAddress"))))).alias("kind"))
    secrets = files.select("folder", F.explode(secrets_of(text)).alias("s")).select("folder")
    return S.data_rights_risk(kinds, secrets, files.filter(F.octet_length("text") > 20_000), by=["folder"])


_DATA_IDS = [(i,) for i in sorted({i for _, i in R.DATA_LICENSES})]


@query(f"SELECT part, licence, obligation FROM {dealt_sql(_DATA_IDS, 'licence')} JOIN ({_values([(n, o) for n, d in S.DATA_DUTIES for o in d])}) d(licence, obligation) USING (licence)")
def data_licence_duties(spark, sf_dir):
    return dealt(spark, sf_dir, _DATA_IDS, "licence").select("part", "licence", F.explode(S.data_duties(F.col("licence"))).alias("obligation"))
