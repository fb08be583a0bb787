"""Thin driver queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .ann import nearest
from .common import tune
from .importance import resample
from .jaccard import near_duplicates
from .langid import held_out, identify, train
from .mixing import draw
from .packing import pack_documents
from .pii import find_personal_data
from .records import read_records, write_records
from .substring import dedup_substrings
from .token_counts import token_counts
from .topk import topk_inner_product
from .whitening import fit, whiten

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_inner_product(_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=20, query=F.col("_id") % 20 == 0)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``draws`` tells which shard took how many words in which pass: ``pass:shard:words``, joined by commas."""
    drawn = draw(_table(spark, sf_dir, "documents"), payload=[])
    taken = F.aggregate("_draws", F.lit(0).cast("long"), lambda n, d: n + d["take"])
    said = F.array_join(F.transform("_draws", lambda d: F.concat_ws(":", d["pass"], d["shard"], d["take"])), ",")
    return drawn.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), taken.alias("taken"), said.alias("draws"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents")).drop("mark")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(spark, manifest)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation_exact`` holds deviations that a long cannot."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    one = whiten(rows, fit(rows)).select("vec_id", "whitened.*")
    each = one.select("vec_id", "n", "deviation", "deviation_exact", "identity_error", F.posexplode(F.arrays_zip("values", "explained")).alias("k", "at"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", F.col("at")["values"].alias("whitened"), F.col("at")["explained"].alias("explained"), "identity_error", "deviation_exact")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


#: Exact search as SQL: integer inner products of the whole table.
OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

#: CRC-32 is linear: a checksum is the exclusive or of what each byte contributes at its distance from the end, and of the
#: start value after as many bytes as the feature has.
OP12_SQL = """
WITH RECURSIVE bits(b, v, k) AS (
  SELECT b, b, 0 FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), one AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
sized AS MATERIALIZED (
  SELECT doc_id, text, 0 AS kind FROM documents UNION ALL SELECT NULL, text, 1 FROM benchmark
), rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, kind,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM sized
), grams AS MATERIALIZED (
  SELECT r, f, count(*) AS c FROM (
    SELECT r, unnest(w) AS f FROM rows_
    UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM rows_
    UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM rows_
  ) GROUP BY r, f
), feats AS MATERIALIZED (
  SELECT row_number() OVER () AS id, f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM grams)
), after_(k, b, v) AS (
  SELECT 0, b, v FROM one
  UNION ALL
  SELECT a.k + 1, a.b, xor(a.v >> 8, o.v) FROM after_ a JOIN one o ON o.b = a.v & 255 WHERE a.k < (SELECT max(len(h)) // 2 FROM feats)
), after2 AS MATERIALIZED (SELECT k, printf('%02X', b) AS b, v FROM after_),
start_(k, v) AS (
  SELECT 0, 4294967295
  UNION ALL
  SELECT s.k + 1, xor(s.v >> 8, o.v) FROM start_ s JOIN one o ON o.b = s.v & 255 WHERE s.k < (SELECT max(len(h)) // 2 FROM feats)
), bytes_ AS (
  SELECT id, len(h) // 2 AS n, unnest(range(len(h) // 2)) AS i, h FROM feats
), crc AS MATERIALIZED (
  SELECT x.id, xor(xor(x.v, s.v), 4294967295) % 10000 AS bucket
  FROM (SELECT y.id, y.n, bit_xor(a.v) AS v FROM bytes_ y JOIN after2 a ON a.k = y.n - 1 - y.i AND a.b = substr(y.h, CAST(2 * y.i + 1 AS INT), 2) GROUP BY y.id, y.n) x
  JOIN start_ s ON s.k = x.n
), counted AS MATERIALIZED (
  SELECT g.r, c.bucket, sum(g.c) AS c FROM grams g JOIN feats USING (f) JOIN crc c USING (id) GROUP BY g.r, c.bucket
), sums AS (
  SELECT bucket, sum(CASE WHEN kind = 0 THEN c ELSE 0 END) AS s, sum(CASE WHEN kind = 1 THEN c ELSE 0 END) AS t FROM counted JOIN rows_ USING (r) GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM sums) + 10000 AS DOUBLE))
         / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM sums) + 10000 AS DOUBLE)))) AS g FROM sums
), weighed AS (
  SELECT r, sum(c) AS n, sum(c * g) AS weight FROM counted JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT r, d.doc_id, len(d.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || left(sha256('42:' || d.doc_id), 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM rows_ d LEFT JOIN weighed USING (r) WHERE kind = 0
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS p, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN p <= 5 * n // 100 THEN p END AS rank
FROM scored LEFT JOIN placed USING (r)
"""

QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_topk": op2_exact_topk,
    "op3_packing": op3_packing,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_language_id": op5_language_id,
    "op6_source_mixing": op6_source_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_records": op10_token_records,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {"op2_exact_topk": OP2_SQL, "op12_importance_resampling": OP12_SQL}
